"""Lists for people: entries by category, padded rows, counters of pages, demand by size, files to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_category(df: DataFrame, category: str, order: list[str], shown: list[str]) -> DataFrame:
    """(category, place, n, and the sorted different values of each of ``shown``); categories outside ``order`` come last.

    ``shown`` are columns of few values, as facets are; their sets are built map-side.
    """
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(category))
    place = F.when(at > 0, at).otherwise(len(order) + 1).cast("int")
    sets = [F.array_sort(F.collect_set(c)).alias(c) for c in shown]
    return df.groupBy(category).agg(F.count("*").alias("n"), *sets).select(category, place.alias("place"), "n", *shown)


def padded_rows(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    """``df`` with ``line``: its columns, each as wide as its title and longest value, two blanks between; null is empty.

    One aggregate finds the widths, a number a column; the rows are not gathered.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in titles}
    widths = df.agg(*[F.max(F.length(x)).alias(c) for c, x in text.items()]).first()
    cells = [F.rpad(text[c], max(len(title), widths[c] or 0), " ") for c, title in titles.items()]
    return df.withColumn("line", F.rtrim(F.concat_ws("  ", *cells)))


def counter(c: Column, pattern: str, group: int = 1, required: bool = False) -> Column:
    """The number in a page's text, thousands commas dropped; without a match null, or an error where it is ``required``."""
    found = F.nullif(F.regexp_replace(F.regexp_extract(c, pattern, group), ",", ""), F.lit(""))
    if required:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no counter in the page: "), F.substring(c, 1, 80))))
    return found.cast("long")


def demand_by_size(rails: DataFrame, stock: DataFrame, size: str, amps: str, need: str, have: str) -> DataFrame:
    """(size, max_amps, needed, available, short): both sides are summed by size before they meet."""
    asked = rails.groupBy(size).agg(F.max(amps).alias("max_amps"), F.sum(need).alias("needed"))
    there = stock.groupBy(size).agg(F.sum(have).alias("available"))
    left = F.coalesce("available", F.lit(0))
    return asked.join(there, size, "left").select(
        size, "max_amps", "needed", left.alias("available"), F.greatest(F.lit(0), F.col("needed") - left).alias("short")
    )


def without_superseded(files: DataFrame, name: str, bare: str, rich: str) -> DataFrame:
    """Names that end in ``bare`` and have no sibling that ends in ``rich`` instead."""
    stem = lambda end: F.expr(f"left({name}, length({name}) - {len(end)})").alias("stem")
    richer = files.where(F.col(name).endswith(rich)).select(stem(rich)).distinct()
    return files.where(F.col(name).endswith(bare)).select(name, stem(bare)).join(richer, "stem", "left_anti").select(name).distinct()
