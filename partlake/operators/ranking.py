"""Numbering rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partlake.scratch import Scratch


def numbered(df: DataFrame, part: list[str], order: list, name: str = "place") -> DataFrame:
    """Add ``name``, counting from 1 in each group, as ``row_number`` would, without a group in one task.

    Rows are sorted by ranges of (group, order); a row's number is its position in its range,
    less where its group begins there, plus the group's rows in earlier ranges, which are known
    from one row a group and range. Null groups are one group. Rows that tie in all of
    ``order`` get numbers in no fixed order. The sorted rows are written to the scratch folder.
    """
    keys = [F.asc_nulls_first(c) for c in part] + [*order, "__any"]
    place = F.monotonically_increasing_id()
    placed = df.withColumn("__any", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.select(*df.columns, F.shiftright(place, 33).alias("__range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    placed = Scratch(df.sparkSession, "numbered").write(placed, "rows", keep=True)
    runs = placed.groupBy(*part, "__range").agg(F.min("__at").alias("__lo"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*part).orderBy("__range")) - F.col("__n")
    runs = runs.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(part)], F.col("__range").alias("__r"), (before - F.col("__lo")).alias("__shift"))
    same = placed["__range"] == runs["__r"]
    for i, c in enumerate(part):
        same = same & placed[c].eqNullSafe(runs[f"__p{i}"])
    return placed.join(runs, same).select(*df.columns, (F.col("__at") + F.col("__shift") + 1).alias(name))
