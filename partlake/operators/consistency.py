"""Checks between tables: parity, drift, domains, coverage, text grounding. A result is (check, n_rows, n_bad, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, total: Column, bad: Column) -> DataFrame:
    out = df.agg(total.cast("long").alias("n_rows"), bad.cast("long").alias("n_bad"))
    return out.select(F.lit(name).alias("check"), "n_rows", F.coalesce("n_bad", F.lit(0)).alias("n_bad"), F.when(F.coalesce("n_bad", F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("status"))


def parity(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Rows that one table has more often than the other, as multisets: one shuffle with signed counts for both ways."""
    cols = a.columns
    signed = a.withColumn("__s", F.lit(1)).unionByName(b.select(*cols).withColumn("__s", F.lit(-1)))
    net = signed.groupBy(*cols).agg(F.sum("__s").alias("d"), F.count("*").alias("c"))
    return _row(net, name, F.sum("c"), F.sum(F.abs("d")))


def drift(stored: DataFrame, made: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, ``field``): fields that differ between a stored and a regenerated table, nulls equal; ``missing`` or ``extra`` for whole rows."""
    s = stored.select(key, F.struct(*fields).alias("s"))
    m = made.select(key, F.struct(*fields).alias("m"))
    both = s.join(m, key, "full")
    per_field = F.array(*[F.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"m.{f}")), f) for f in fields])
    found = F.when(F.col("m").isNull(), F.array(F.lit("missing"))).when(F.col("s").isNull(), F.array(F.lit("extra"))).otherwise(F.array_compact(per_field))
    return both.select(key, F.explode(found).alias("field"))


def in_domain(df: DataFrame, col: str, domain: DataFrame, name: str) -> DataFrame:
    """Values that the domain's first column does not have; a semi join over distinct values."""
    d = domain.select(F.col(domain.columns[0]).alias("__d")).distinct().withColumn("__ok", F.lit(True))
    values = df.groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("n")).join(d, F.col("__v") == F.col("__d"), "left")
    return _row(values, name, F.sum("n"), F.sum(F.when(F.col("__ok").isNull(), F.col("n")).otherwise(0)))


def letters_in(df: DataFrame, col: str, letters: str, name: str) -> DataFrame:
    """Rows whose text has a letter outside the given ones."""
    return _row(df, name, F.count("*"), F.count_if(~F.col(col).rlike(f"^[{letters}]*$")))


def ordered(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """Rows whose low end is above the high one."""
    return _row(df, name, F.count("*"), F.count_if(~F.coalesce(F.col(low) <= F.col(high), F.lit(False))))


def only_in(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Different values of a column of ``a`` that ``b`` does not have."""
    return a.select(col).distinct().join(b.select(col).distinct(), col, "left_anti")


def inventory(manifest: DataFrame, disk: DataFrame, col: str) -> DataFrame:
    """(col, ``listed``, ``found``): every name once, and where it is; one shuffle."""
    both = manifest.select(col, F.lit(True).alias("l"), F.lit(False).alias("f")).union(disk.select(col, F.lit(False), F.lit(True)))
    return both.groupBy(col).agg(F.bool_or("l").alias("listed"), F.bool_or("f").alias("found"))


def honours_any(rows: DataFrame, combos: DataFrame, on: str, key: str, test: Column) -> DataFrame:
    """(key, ``honoured``): whether a row meets the test with any combination of its ``on``; without combinations it does not."""
    return rows.join(combos, on, "left").groupBy(key).agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("honoured"))
