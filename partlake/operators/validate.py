"""Validation status of part numbers and their mating counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators.decode import part_number


def validation_status() -> Column:
    """First rung that holds, from ``error`` and the membership flags in_corpus, in_verified, in_secondary."""
    return (
        F.when(F.col("error").isNotNull(), "missing data")
        .when(F.col("in_corpus"), "exact match")
        .when(F.col("in_verified"), "verified")
        .when(F.col("in_secondary"), "secondary exact")
        .when(F.col("sheet").isin(R.HERMETIC_SHEETS), "vendor specific")
        .otherwise("valid format, not confirmed")
    )


def mate_edges(spark) -> DataFrame:
    """(sheet, mate) both ways; a dozen fixed rows."""
    pairs = [(s, m) for s, mates in R.MATING_SHEETS for m in mates]
    return spark.createDataFrame(sorted({*pairs, *((m, s) for s, m in pairs)}), "sheet string, mate string")


def opposite_contact(col: str = "contact") -> Column:
    both = [(a, b) for a, b in R.CONTACT_PAIRS] + [(b, a) for a, b in R.CONTACT_PAIRS]
    return F.try_element_at(F.create_map(*[F.lit(x) for p in both for x in p]), F.col(col))


def mates(parsed: DataFrame) -> DataFrame:
    """(all columns, ``mate``, ``mate_contact``, ``mate_pn``, ``fails``): every counterpart sheet of a decoded row.

    ``fails`` lists what stands against the pair; a contact letter without opposite gives no number.
    """
    edges = F.broadcast(mate_edges(parsed.sparkSession))  # a dozen rows
    j = parsed.where("error IS NULL").join(edges, "sheet").withColumn("mate_contact", opposite_contact())
    known = [c for c, _ in R.CONTACTS]
    checks = F.array(
        F.when(F.col("mate_contact").isNull(), "no opposite contact"),
        F.when(~F.col("contact").isin(known), "contact unknown"),
        F.when(~F.col("key").isin(*R.KEYS_IV), "key unknown"),
        F.when(F.col("series").eqNullSafe("III") & ~F.col("key").isin(*R.KEYS_III), "key not in series"),
    )
    return j.withColumn("mate_pn", part_number("mate", "class", "size", "insert", F.col("mate_contact"), "key")).withColumn(
        "fails", F.filter(checks, lambda c: c.isNotNull())
    )


STATUS_POINTS = [("exact match", 20), ("verified", 20), ("secondary exact", 10), ("valid format, not confirmed", 5), ("vendor specific", -8)]


def mate_score(status: str = "status") -> Column:
    """Hundredths from 0 to 99: 18 series, 18 size, 18 insert, 16 key, 16 opposite contact, 8 opposite role, and the status."""
    points = F.lit(18 + 18 + 18 + 16 + 16 + 8)
    for s, n in STATUS_POINTS:
        points = points + F.when(F.col(status) == s, F.lit(n)).otherwise(F.lit(0))
    return F.when(F.size("fails") > 0, F.lit(0)).otherwise(F.least(F.lit(99), F.greatest(F.lit(0), points)))
