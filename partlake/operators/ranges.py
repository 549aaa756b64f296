"""Joins on ranges as joins on equal keys, so that they shuffle by key and never compare all pairs.

Each pair that meets the condition is made exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that ``at_least`` compares lie below 2 to this power.
BITS = 31


def at_least(left: DataFrame, right: DataFrame, need: str, have: str, bits: int = BITS) -> DataFrame:
    """Pairs with ``have >= need``, for whole numbers below ``2 ** bits``; a need below 1 counts as 1, a null meets nothing.

    Let c be need - 1. A larger number x first differs from c in one bit, where c has 0 and x has
    1; above it they agree. So x meets c at the one level l where x >> l is odd and equals
    (c >> l) + 1: a row goes to at most ``bits`` levels, and a pair meets in one.
    """
    c = F.greatest(F.col(need).cast("long"), F.lit(1)) - 1
    levels = F.sequence(F.lit(0), F.lit(bits - 1))
    even = F.filter(F.transform(levels, lambda l: F.struct(l.alias("l"), (_shift(c, l) + 1).alias("k"))), lambda s: s["k"] % 2 == 1)
    odd = F.filter(F.transform(levels, lambda l: F.struct(l.alias("l"), _shift(F.col(have).cast("long"), l).alias("k"))), lambda s: s["k"] % 2 == 1)
    a = left.where(F.col(need).isNotNull()).withColumn("__key", F.explode(even))
    b = right.where(F.col(have) > 0).withColumn("__key", F.explode(odd))
    return a.join(b, "__key").drop("__key")


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def in_spans(points: DataFrame, spans: DataFrame, group: str, value: str, first: str, last: str, width: int) -> DataFrame:
    """Points with the spans of their group that hold them (``first <= value <= last``, whole numbers); null groups meet.

    A span goes to every cell of ``width`` values that it touches, a point to its own.
    """
    a = points.withColumn("__cell", F.floor(F.col(value) / width))
    cells = F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))
    b = spans.where(F.col(first) <= F.col(last)).withColumn("__cell", F.explode(cells)).withColumnRenamed(group, "__group")
    same = a[group].eqNullSafe(b["__group"]) & (a["__cell"] == b["__cell"]) & a[value].between(b[first], b[last])
    return a.join(b, same).drop("__group", "__cell")


def overlapping(a: DataFrame, b: DataFrame, group: str, side: float, salt: int = 1) -> DataFrame:
    """(group, a, b): boxes of ``a`` and ``b`` (columns id, x0, y0, x1, y1) in one group that share an area.

    Boxes are dealt to square tiles of length ``side``; a pair that meets in several tiles is kept
    in the tile of the lower left corner of its common area. With ``salt`` above 1 every tile is
    split: a box of ``a`` goes to one of that many parts, a box of ``b`` to all. Boxes without an
    area, or with a null or infinite side, meet nothing.
    """

    def tiles(lo: str, hi: str) -> Column:
        # the upper edge belongs to no tile of its own
        return F.sequence(F.floor(F.col(lo) / side), F.greatest(F.ceil(F.col(hi) / side) - 1, F.floor(F.col(lo) / side)))

    def dealt(df: DataFrame, name: str) -> DataFrame:
        finite = F.lit(True)
        for c in ("x0", "y0", "x1", "y1"):
            finite = finite & (F.abs(F.col(c)) < 1e15)
        real = df.where(finite & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
        box = F.struct("id", "x0", "y0", "x1", "y1").alias(name)
        return real.select(F.col(group), box, F.explode(tiles("x0", "x1")).alias("__x"), F.col("y0"), F.col("y1")).select(group, name, "__x", F.explode(tiles("y0", "y1")).alias("__y"))

    left = dealt(a, "a").withColumn("__salt", F.pmod(F.xxhash64("a.id"), F.lit(salt)).cast("int"))
    right = dealt(b, "b").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    pairs = left.join(right, [group, "__x", "__y", "__salt"])
    x, y = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    here = (F.floor(x / side) == F.col("__x")) & (F.floor(y / side) == F.col("__y"))
    area = (x < F.least("a.x1", "b.x1")) & (y < F.least("a.y1", "b.y1"))
    return pairs.where(here & area).select(group, F.col("a.id").alias("a"), F.col("b.id").alias("b"))
