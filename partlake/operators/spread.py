"""Tables of few bytes whose rows take long."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt evenly to as many tasks as a shuffle has.

    Files are read by bytes and row groups, so a small file keeps most cores idle; put this between
    the read and the work, where the rows are still short.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
