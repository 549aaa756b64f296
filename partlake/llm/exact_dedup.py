"""Exact deduplication with a heavy-hitter split.

Each row is reduced once to (digest, length, id). Misra-Gries summaries, one per
partition and merged, name every digest that holds more than ``1 / (counters + 1)``
of the rows; the winners of those digests are found exactly and broadcast (at most
``counters`` rows), so the rows of a huge group are resolved where they lie. All
other digests are resolved by an ordinary shuffle, which no group can dominate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partlake.llm.rows import drop_keys, fresh
from partlake.llm.scratch import Scratch

BLANKS = r"[\x20\x09-\x0D]"


class MisraGries:
    """At most ``size`` counters; an item of more than n / (size + 1) of n additions always keeps one."""

    def __init__(self, size: int):
        self.size = size
        self.counts: dict = {}

    def add(self, item, n: int = 1) -> None:
        c = self.counts
        if item in c:
            c[item] += n
        else:
            c[item] = n
            if len(c) > 2 * self.size:  # shrink in blocks: the cost of a cut is spread over size additions
                self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.size:
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {k: v - cut for k, v in self.counts.items() if v > cut}


def heavy_items(df: DataFrame, col: str, counters: int) -> DataFrame:
    """Candidates for the heavy values of a string column: one row each, ``counters`` rows at most."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mg = MisraGries(counters)
        for b in batches:
            counted = b.column(0).value_counts()
            for item, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                mg.add(item, n)
        mg.shrink()
        yield pa.RecordBatch.from_pydict(
            {"item": pa.array(list(mg.counts), pa.string()), "n": pa.array(list(mg.counts.values()), pa.int64())}
        )

    parts = df.select(F.col(col)).mapInArrow(summarise, "item string, n long")
    merged = parts.groupBy("item").agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), "item").limit(counters).select(F.col("item").alias(col))


def group_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical without the characters space and U+0009 to
    U+000D; null counts as empty. The row with the most code points in its original
    text, then the smallest id (null last), stays. Of rows that repeat an id inside a
    group one only has ``kept``. Ids are numbers. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.char_length(text).cast("long").alias("len"),
        F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256).alias("digest"),
    ).withColumn("uid", F.monotonically_increasing_id())
    slim = scratch.write(slim, "digests")

    # the winner is the largest of these structs; its uid tells rows with one id apart
    best = F.max_by(
        F.struct("id", "uid"),
        F.struct("len", F.col("id").isNotNull(), -F.coalesce(F.col("id"), F.lit(0)), -F.col("uid")),
    )
    named = scratch.write(heavy_items(slim, "digest", counters), "candidates")
    heavy = F.broadcast(named)  # counters rows at most
    winners = slim.join(heavy, "digest").groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    winners = scratch.write(winners, "winners")  # counters rows at most
    hot = slim.join(F.broadcast(winners), "digest")
    rest = slim.join(heavy, "digest", "left_anti")
    light = rest.join(
        rest.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")), "digest"
    )
    out = hot.unionByName(light).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    out = scratch.write(out, "result", keep=True)
    scratch.clear()
    return out


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows equal in id and normalised text the longest stays.

    Ids must be numbers. Null texts count as empty and are one group; null ids equal each other. An
    empty table stays empty; columns of any name pass through as they are.
    """
    said = group_copies(docs, id_col, text_col, counters)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256)
    gone = said.where(~F.col(id_col).eqNullSafe(F.col("keep_id")))
    key = fresh(docs, "__key")
    keyed = docs.withColumn(key, digest)
    left = drop_keys(keyed, gone, {id_col: id_col, key: "text_sha256"}, Scratch(docs.sparkSession, "exact-dedup"))
    if said.where(F.col(id_col).eqNullSafe(F.col("keep_id")) & ~F.col("kept")).limit(1).count():  # ids that repeat
        place = fresh(keyed, "__rn")
        first = Window.partitionBy(id_col, key).orderBy(F.char_length(text).desc())
        left = left.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return left.select(*docs.columns)
