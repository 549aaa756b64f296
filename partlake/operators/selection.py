"""Choosing arrangements for a set of loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES = ["22D", "20", "16", "12"]


def fit_sizes(df: DataFrame, need: list[str], have: list[str]) -> DataFrame:
    """Add ``fits``, ``upsizes`` and ``spare``: needs are served smallest size first, each from its own size or the next larger with room.

    One column for each size; the loop over sizes is unrolled, so a row is decided without a shuffle.
    """
    rest = [F.col(h) for h in have]
    ok, ups = F.lit(True), F.lit(0)
    for i, n in enumerate(need):
        want = F.col(n)
        at = F.lit(-1)
        for j in reversed(range(i, len(have))):
            at = F.when(rest[j] >= want, F.lit(j)).otherwise(at)
        at = F.when(want == 0, F.lit(i)).otherwise(at)
        df = df.withColumn(f"__at{i}", at)
        at = F.col(f"__at{i}")
        df = df.withColumns({f"__r{i}_{j}": F.when(at == j, rest[j] - want).otherwise(rest[j]) for j in range(len(have))})
        rest = [F.col(f"__r{i}_{j}") for j in range(len(have))]
        ok, ups = ok & (at >= 0), ups + F.when(at > i, 1).otherwise(0)
    total = rest[0]
    for r in rest[1:]:
        total = total + r
    extra = [c for c in df.columns if c.startswith("__")]
    return df.withColumns({"fits": ok, "upsizes": ups, "spare": total}).drop(*extra)


def best_fits(df: DataFrame, key: str, tie: str, top: int) -> DataFrame:
    """The ``top`` arrangements of each need: fewest upsizes, then most spare contacts, then the tie column."""
    w = Window.partitionBy(key).orderBy("upsizes", F.desc("spare"), tie)
    return df.where("fits").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def contact_notes(col: str) -> Column:
    """``3 #22D, 2 #8 Coax`` as an array of (count, size)."""
    pattern = F.lit(r"(\d+)\s*x?\s*#\s*(\d+D?(?: Coax| Twinax)?)")
    n = F.transform(F.regexp_extract_all(F.col(col), pattern, 1), lambda x: x.cast("int"))
    return F.arrays_zip(n.alias("count"), F.regexp_extract_all(F.col(col), pattern, 2).alias("size"))


def contact_type(size: Column) -> Column:
    return F.when(size.contains("Coax"), "coax").when(size.contains("Twinax"), "twinax").otherwise("signal")
