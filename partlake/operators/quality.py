"""Data-quality checks: each is one row, all checks of a table are one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n_rows, n_bad, status): rows that break each condition; null counts as broken. One pass over the table."""
    aggs = [F.count("*").alias("n_rows")]
    aggs += [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("n_bad")) for i, name in enumerate(checks)])
    out = one.select("n_rows", F.explode(rows).alias("r")).select("r.check", "n_rows", "r.n_bad")
    return out.withColumn("status", F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL"))


def unique_key(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """One check row: keys that occur more than once."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    out = counts.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_bad"))
    return out.select(F.lit(name).alias("check"), "n_rows", "n_bad", F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL").alias("status"))


def missing_parents(child: DataFrame, parent: DataFrame, key: str, parent_key: str, name: str) -> DataFrame:
    """One check row: child rows without a parent."""
    lost = child.join(parent.select(F.col(parent_key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    total = child.agg(F.count("*").alias("n_rows"))
    bad = lost.agg(F.count("*").alias("n_bad"))
    out = total.join(F.broadcast(bad))  # one row each
    return out.select(F.lit(name).alias("check"), "n_rows", "n_bad", F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL").alias("status"))
