"""Evidence from several sources merged to one record a part number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCES = ["verified", "secondary", "listed", "qualified", "example"]


def tag_sources(feed: DataFrame) -> DataFrame:
    """(key, source, ord): which sources name a part number, by divisibility of the order key."""
    tags = [("verified", 11), ("secondary", 3), ("listed", 2), ("qualified", 5), ("example", 7)]
    arr = F.array(*[F.when(F.col("l_orderkey") % m == 0, F.lit(s)) for s, m in tags])
    return feed.withColumn("source", F.explode(F.filter(arr, lambda s: s.isNotNull())))


def evidence_level(prefix: str = "") -> Column:
    """The first level that the source flags reach."""
    f = lambda s: F.col(prefix + s)
    return (
        F.when(f("verified"), "verified exact")
        .when(f("listed") & f("secondary"), "listed and secondary")
        .when(f("qualified"), "qualified source")
        .when(f("listed"), "listed")
        .when(f("secondary"), "secondary exact")
        .when(f("example"), "catalog example")
        .otherwise("other")
    )


def merge_evidence(tagged: DataFrame, key: str = "key") -> DataFrame:
    """One row a key: a flag for each source, sorted distinct vendors, first text, latest order, and the level.

    One shuffle on the key; every aggregate combines on the map side.
    """
    flags = [F.bool_or(F.col("source") == s).alias(s) for s in SOURCES]
    merged = tagged.groupBy(key).agg(
        *flags,
        F.min("raw_pn").alias("first_text"),
        F.max("l_orderkey").alias("last_order"),
        F.count_distinct("l_suppkey").alias("n_suppliers"),
    )
    return merged.withColumn("level", evidence_level())


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, ``change``): added, removed or kept; distinct keys, one shuffle for both sides."""
    both = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select(key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    sides = both.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    change = F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed").otherwise("kept")
    return sides.select(key, change.alias("change"))


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key; a total order makes it the same on every run."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_wins(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value with the largest order of each key, by one mergeable aggregate."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))
