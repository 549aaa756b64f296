"""All combinations of lists, numbered, so that any of them is made from its number.

A cell is a row with some lists; its combinations are the numbers below the product of
their lengths, read in a mixed radix, the last list fastest. Cells laid end to end number the
whole. A sample is a set of numbers: it meets the cells in a join on ranges and never
needs the combinations that it does not take.
"""

from __future__ import annotations

from hashlib import sha256
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.operators import ranges

#: Numbers below this keep the products of ``sample`` inside 64 bits.
MOST = 3_000_000_000


def size_of(lists: list[str]) -> Column:
    """Combinations of a cell; 0 where a list is empty or null."""
    out = F.lit(1).cast("long")
    for c in lists:
        out = out * F.coalesce(F.size(c), F.lit(0))
    return F.greatest(out, F.lit(0).cast("long"))


def chosen(lists: list[str], number: Column) -> dict[str, Column]:
    """The element of each list that a number of a cell (from 0) stands for."""
    out, rest = {}, number
    for c in reversed(lists):
        n = F.size(c)
        out[c] = F.get(F.col(c), F.pmod(rest, n).cast("int"))
        rest = F.floor(rest / n)
    return {c: out[c] for c in lists}


def numbered_cells(cells: DataFrame, lists: list[str], order: list[str]) -> DataFrame:
    """``cells`` with ``first`` and ``last``, the numbers of its combinations; empty cells are left out.

    Cells are a catalog's rules: they are numbered in one task, at some 100 bytes each.
    """
    sized = cells.withColumn("__n", size_of(lists)).where("__n > 0")
    last = F.sum("__n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sized.withColumn("last", last - 1).withColumn("first", F.col("last") - F.col("__n") + 1).drop("__n")


def all_combinations(cells: DataFrame, lists: list[str]) -> DataFrame:
    """Every combination of every cell, one row each, ``number`` counting from 0 in its cell; the lists become single values."""
    rows = cells.withColumn("__n", size_of(lists)).where("__n > 0").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return rows.withColumns(chosen(lists, F.col("number"))).drop("__n")


def stride(total: int, seed: int) -> tuple[int, int]:
    """(a, b) so that i -> (a * i + b) mod total visits every number once; they follow from the seed."""
    h = sha256(f"{seed}:{total}".encode()).digest()
    a, b = int.from_bytes(h[:8], "big") % total or 1, int.from_bytes(h[8:16], "big") % total
    while gcd(a, total) > 1:
        a = a % total + 1
    return a, b


def sample(cells: DataFrame, lists: list[str], order: list[str], n: int, seed: int) -> DataFrame:
    """``n`` different combinations (all, if fewer) of all cells together, with their ``number`` over all cells.

    The same on every run and for every partitioning. The numbers are ``stride``'s first ones:
    spread evenly over the cells, not drawn independently. At most ``MOST`` combinations.
    """
    spark = cells.sparkSession
    laid = numbered_cells(cells, lists, order)
    total = (laid.agg(F.max("last")).first()[0] or -1) + 1
    if total > MOST:
        raise ValueError(f"{total} combinations, more than {MOST}")
    a, b = stride(total, seed) if total else (1, 0)
    numbers = spark.range(min(n, total)).select(F.lit(0).alias("__all"), F.expr(f"(id * {a} + {b}) % {max(total, 1)}").alias("number"))
    width = max(1, total // 4096)  # a cell of the join holds some of the sample, a list's cell touches few
    met = ranges.in_spans(numbers, laid.withColumn("__all", F.lit(0)), "__all", "number", "first", "last", width)
    return met.withColumns(chosen(lists, F.col("number") - F.col("first"))).drop("__all", "first", "last")
