"""Search, filters, facets and the selector tree over catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def filter_catalog(df: DataFrame, equal: dict[str, object] | None = None, contains: tuple[list[str], str] | None = None) -> DataFrame:
    """Rows that meet all given equalities (None: not asked) and hold the needle, in any case, in one of the columns."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if contains and contains[1]:
        hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in contains[0]]))
        df = df.where(hay.contains(contains[1].lower()))
    return df


def facets(df: DataFrame, cols: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass: rows are expanded to their facet values, then counted once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def tiered_search(df: DataFrame, col: str, needle: str) -> DataFrame:
    """Rows of the first tier with a hit: exact, then any case, then prefix, then inside; with ``tier``.

    The least tier is one aggregate of one row; only matching rows are looked at again.
    """
    c, low = F.col(col), F.lower(F.col(col))
    tier = (
        F.when(c == needle, 1).when(low == needle.lower(), 2).when(low.startswith(needle.lower()), 3).when(low.contains(needle.lower()), 4)
    )
    hits = df.withColumn("tier", tier).where("tier IS NOT NULL")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best"), "left_semi")  # one row


def keyword_search(df: DataFrame, cols: list[str], word: str, order: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` rows, in order, that hold the word in any column."""
    return filter_catalog(df, None, (cols, word)).orderBy(order).limit(limit)


def rollup_counts(df: DataFrame, path: list[str], leaf: str) -> DataFrame:
    """Distinct leaves under every prefix of a path (null: all below), ``depth`` levels deep."""
    return df.rollup(*path).agg(F.count_distinct(leaf).alias("n_leaves"), F.grouping_id().alias("gid"))


def build_numbers(spark: SparkSession, sheets: list[str], classes: list[str], sizes: list[str], inserts: list[str]) -> DataFrame:
    """(pn): all combinations of the selector's values, exploded one list after another."""
    df = spark.range(1).select(F.lit("D38999/").alias("pn"))
    for xs in (sheets, classes, sizes, inserts):
        df = df.withColumn("__x", F.explode(F.array(*[F.lit(x) for x in xs]))).select(F.concat("pn", "__x").alias("pn"))
    return df.select(F.concat("pn", F.lit("PN")).alias("pn"))


def top_with_ties(df: DataFrame, group: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of a column, ties by value."""
    return df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(n)


def neighbours(df: DataFrame, part: str, order: str) -> DataFrame:
    """Each row's previous and next in its group's order, wrapping around."""
    w = Window.partitionBy(part).orderBy(order)
    whole = Window.partitionBy(part)
    return df.withColumn("prev", F.coalesce(F.lag(order).over(w), F.max(order).over(whole))).withColumn(
        "next", F.coalesce(F.lead(order).over(w), F.min(order).over(whole))
    )


def query_kind(col: str) -> Column:
    """What a search text is: an arrangement id, a standard part number, or a vendor number."""
    x = F.upper(F.trim(F.col(col)))
    return (
        F.when(x.rlike(r"^\d{1,2}-\d{1,3}$"), "arrangement").when(x.rlike(r"^(D38999)?/?\d{2}[A-Z]"), "part number").otherwise("vendor number")
    )
