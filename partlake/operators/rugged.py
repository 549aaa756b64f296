"""Recognition of ruggedised interface families by ordered prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Our own family table: order, prefix, family, category.
FAMILIES = [
    (0, "RJF", "field ethernet", "ethernet"), (1, "RJ", "plain ethernet", "ethernet"), (2, "USB3", "field usb 3", "usb"),
    (3, "USB", "field usb", "usb"), (4, "HDMI", "field hdmi", "video"), (5, "PART", "catalog part", "other"), (6, "P", "plain part", "other"),
]


def recognise(df: DataFrame, col: str, families: list[tuple] = FAMILIES) -> DataFrame:
    """Add ``family``, ``category`` and ``suffix`` of the first prefix in table order; null when none fits.

    The order of the table decides, not the length. A dozen prefixes are one chain of
    conditions: no join.
    """
    x = F.upper(F.regexp_replace(F.col(col), r"[\s-]+", ""))
    none = F.lit(None).cast("struct<ord:int,prefix:string,family:string,category:string>")
    hit = none
    for o, p, fam, cat in reversed(families):
        here = F.struct(F.lit(o).alias("ord"), F.lit(p).alias("prefix"), F.lit(fam).alias("family"), F.lit(cat).alias("category"))
        hit = F.when(x.startswith(p.replace("-", "").replace(" ", "").upper()), here).otherwise(hit)
    df = df.withColumn("__hit", hit)
    suffix = F.when(F.col("__hit").isNotNull(), F.expr(f"substring(`{col}`, length(__hit.prefix) + 1)"))
    return df.select(*df.columns[:-1], F.col("__hit.family").alias("family"), F.col("__hit.category").alias("category"), suffix.alias("suffix"))


def mount(suffix: Column) -> Column:
    """Mount by the last rule that speaks: first suffix character, then tokens."""
    s = F.upper(suffix)
    return (
        F.when(s.rlike("F3(12|11)|F05[89]"), "free")
        .when(s.contains("F459"), "panel")
        .when(s.rlike("G6"), "plug")
        .when(s.rlike("D0|00"), "wall")
        .when(s.rlike("CM|07"), "jam nut")
        .when(s.startswith("6"), "plug")
        .when(s.startswith("7"), "jam nut")
        .when(s.startswith("2"), "box")
    )
