"""Bounded samples for fitting, the same at every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, rows: int, text_col: str, id_col: str, chars: int = 20_000) -> list[str]:
    """At most ``rows`` different texts, cut to ``chars`` characters: those with the smallest hash of id and text.

    The cut-off hash is found on hashes alone, so what reaches the driver is ``rows * chars``
    characters at most, whatever the size of the table.
    """
    keyed = df.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("h"), F.substring(text_col, 1, chars).alias("t"))
    cut = keyed.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if cut is None:
        return []
    return [r[0] for r in keyed.where(F.col("h") <= cut).groupBy("h").agg(F.first("t").alias("t")).orderBy("h").select("t").collect()]
