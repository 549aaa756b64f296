"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash inside their source, ranked there, and placed
at the fractional rank ``(2 * rank - 1) / (2 * rows of the source)``. Sorting the
whole table by that fraction interleaves the sources in proportion; cutting the
sorted order into equal runs gives shards that all carry the corpus mixture and
whose row counts differ by one at most.

No source is ever ranked by one task: the hash orders the rows, so its leading
bits cut a source of any size into even buckets, and a bucket's first rank is the
sum of the counts before it. The fractions of a source are equally spaced, so the
number of rows in any slice of (0, 1) follows from the source's size alone and the
global order is cut the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stratum(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def interleave_shards(
    docs: DataFrame,
    n_shards: int = 8,
    seed: int = 20_011,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to every row.

    The order depends on the ids, the sources and ``seed`` alone. A null source is a
    stratum of its own. A null id counts as an id of its own kind; rows that repeat an
    id are told apart by their whole content, and rows equal in all columns can take
    each other's places. Input columns named ``shard`` or ``slot`` are replaced; all
    others pass through. An empty table gives an empty result.

    Rows are ranked in buckets whose number and size both grow with the square root of the
    table: for 3e10 rows some 20,000 buckets of 1.4 million slim rows.
    """
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        _stratum(F.col(source_col)).alias("stratum"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1).alias("k"),
        F.col(id_col).cast("string").alias("id"),
        row_hash.alias("tie"),
    )
    sizes = base.groupBy("stratum").agg(F.count("*").alias("n_stratum"))
    total = sizes.agg(F.sum("n_stratum")).first()[0] or 0
    n_buckets = max(1, math.isqrt(total) // 8)

    def bucket() -> Column:
        return F.shiftright(F.shiftright("k", 32) * F.lit(n_buckets).cast("long"), 31)

    # first rank of each (stratum, bucket): one small row each
    starts = base.select("stratum", bucket().alias("hb")).groupBy("stratum", "hb").agg(F.count("*").alias("n"))
    by_stratum = Window.partitionBy("stratum")
    starts = starts.select(
        "stratum",
        "hb",
        (F.sum("n").over(by_stratum.orderBy("hb")) - F.col("n")).alias("before"),
        F.sum("n").over(by_stratum).alias("n_stratum"),
    )
    in_bucket = Window.partitionBy("stratum", "hb").orderBy("k", "id", "tie")
    ranked = (
        base.withColumn("hb", bucket())
        .withColumn("rn", F.row_number().over(in_bucket))
        .join(starts, ["stratum", "hb"])
        .withColumn("rank", F.col("before") + F.col("rn"))
    )

    # slices of (0, 1): their sizes follow from the sizes of the strata
    spread = sizes.withColumn(
        "part",
        F.expr(
            f"""CASE WHEN n_stratum < {n_buckets}
                THEN transform(sequence(1L, n_stratum), r -> named_struct(
                    'fb', ((2 * r - 1) * {n_buckets}L) DIV (2 * n_stratum), 'n', 1L))
                ELSE transform(sequence(0L, {n_buckets - 1}L), j -> named_struct(
                    'fb', j,
                    'n', (((2 * n_stratum * (j + 1) + {n_buckets - 1}L) DIV {n_buckets}L) DIV 2)
                       - (((2 * n_stratum * j + {n_buckets - 1}L) DIV {n_buckets}L) DIV 2)))
                END"""
        ),
    )
    slices = (
        spread.select(F.explode("part").alias("p")).groupBy("p.fb").agg(F.sum("p.n").alias("n"))
        .select("fb", (F.sum("n").over(Window.orderBy("fb")) - F.col("n")).alias("first"))
    )
    fraction = (2 * F.col("rank") - 1).cast("double") / (2 * F.col("n_stratum")).cast("double")
    in_slice = Window.partitionBy("fb").orderBy("fraction", F.xxhash64(F.lit(seed), F.col("stratum")), "stratum", "rank")
    placed = (
        ranked.withColumn("fraction", fraction)
        .withColumn("fb", F.expr(f"((2 * rank - 1) * {n_buckets}L) DIV (2 * n_stratum)"))
        .withColumn("rn", F.row_number().over(in_slice))
        .join(slices, "fb")
        .withColumn("pos", F.col("first") + F.col("rn") - 1)
        .withColumn("shard", F.expr(f"(pos * {n_shards}L) DIV {max(total, 1)}L"))
        .withColumn("slot", F.expr(f"pos - (shard * {total}L + {n_shards - 1}L) DIV {n_shards}L"))
    )
    keep = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*keep, F.col("shard").cast("int").alias("shard"), F.col("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write ``shard=<k>`` folders whose files hold consecutive slots, each sorted by slot."""
    chunk = F.expr(f"slot DIV {rows_per_file}L")
    (
        sharded.withColumn("__chunk", chunk)
        .repartition("shard", "__chunk")
        .sortWithinPartitions("shard", "slot")
        .drop("__chunk")
        .write.partitionBy("shard")
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )
