"""Resampling documents towards a target distribution, by hashed n-gram features.

Every task builds word tries of its own: a node stands for a run of words and holds the
CRC-32 of the run's bytes, continued from its parent's state, so a feature's bucket costs
the bytes of its last word. While counting, nodes also hold how often their run was met;
a trie's counts are added to the totals of the task's buckets when it is full or the task
ends, and Spark adds up the totals. While scoring, nodes hold the gain of their bucket, and
a document is scored by walking its words along the paths. Tries never outgrow ``NODES``
nodes and texts are read in pieces, so memory does not grow with a partition or a text.

The draw sorts ids and scores by ranges and numbers them from the counts of the ranges.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partlake.llm.batches import slices_by_bytes
from partlake.llm.scratch import Scratch

#: Runs without the bytes of ASCII that are neither digits nor letters; every byte over 0x7F is in a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Nodes of a trie, some 300 bytes each, and bytes of a text read at once.
NODES, PIECE = 200_000, 1 << 20


class Node(dict):
    """A run of words: its CRC-32, its count, its gain, and the runs that are one word longer."""

    __slots__ = ("crc", "count", "gain", "trie")

    def __init__(self, crc: int, trie: Trie):
        self.crc, self.count, self.trie = crc, 0, trie
        self.gain = trie.gains[crc % len(trie.gains)] if trie.gains else 0

    def __missing__(self, word: bytes) -> Node:
        self[word] = child = self.trie.grow(zlib.crc32(word if self is self.trie.root else b" " + word, self.crc))
        return child


class Trie:
    def __init__(self, gains: list[int] | None = None):
        self.gains = gains
        self.clear()

    def clear(self) -> None:
        self.nodes: list[Node] = []
        self.root = Node(0, self)

    def grow(self, crc: int) -> Node:
        node = Node(crc, self)
        self.nodes.append(node)
        return node

    def paths(self, words: list[bytes], longest: int, met: int) -> Iterator[list[Node]]:
        """For each length up to ``longest``, the nodes of the runs that end after the first ``met`` words."""
        level: list[Node] = [self.root] * len(words)
        for n in range(longest):
            level = [node[w] for node, w in zip(level, words[n:])]
            yield level[max(0, met - n) :]

    def add_to(self, totals: np.ndarray) -> None:
        """Add the counts to their buckets and start anew."""
        crc = np.fromiter((n.crc for n in self.nodes), np.int64, len(self.nodes))
        count = np.fromiter((n.count for n in self.nodes), np.int64, len(self.nodes))
        np.add.at(totals, crc % len(totals), count)
        self.clear()


def word_pieces(text: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """Words of stretches of a text, each with how many words it repeats from the one before, so that no run is lost or met twice."""
    text = text.translate(LOWER)
    at, tail = 0, []
    while at < len(text):
        end = len(text)
        if at + PIECE < end and (cut := NOT_WORD.search(text, at + PIECE)):
            end = cut.start()
        words = tail + WORD.findall(text, at, end)
        yield words, len(tail)
        at, tail = end, words[len(words) - longest + 1 :] if longest > 1 else []


def _texts(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in slices_by_bytes(batch, col):
            yield part, [x or b"" for x in part.column(col).cast(pa.large_binary()).to_pylist()]


def bucket_totals(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts by bucket; at most ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = np.zeros(buckets, np.int64), Trie()
        for _, texts in _texts(batches, 0):
            for text in texts:
                for words, met in word_pieces(text, longest):
                    for nodes in trie.paths(words, longest, met):
                        for node in nodes:
                            node.count += 1
                    if len(trie.nodes) > NODES:
                        trie.add_to(totals)
        trie.add_to(totals)
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found.astype(np.int32)), "n": pa.array(totals[found])})

    parts = docs.select(F.col(text_col)).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """The gain of each bucket, in thousandths."""

    gains: list[int]
    longest: int


def fit_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, text_col: str = "text", target_col: str = "text") -> Model:
    """Log ratios of the smoothed bucket frequencies of ``target`` and ``docs``, over all their texts."""

    def totals(df: DataFrame, col: str) -> list[int]:
        out = [0] * buckets
        for r in bucket_totals(df, col, longest, buckets).collect():  # a row for each bucket at most
            out[r.bucket] = r.n
        return out

    s, t = totals(docs, text_col), totals(target, target_col)
    all_s, all_t = sum(s), sum(t)
    ratio = [(b + 1.0) * (all_s + buckets) / ((a + 1.0) * (all_t + buckets)) for a, b in zip(s, t)]
    return Model([math.floor(1000 * math.log(x)) for x in ratio], longest)


def noise(doc_id: int | None, seed: int) -> int:
    """The document's Gumbel noise in thousandths, from the hash of seed and id (a null id is an empty string)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, model: Model, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_words``, ``n_features``, ``weight``, ``score``) of every row.

    The weight is the mean gain of the features, rounded down, 0 without features.
    """
    gains, longest = model.gains, model.longest
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(gains)
        for part, texts in _texts(batches, 1):
            ids, out = part.column(0), []
            for doc_id, text in zip(ids.to_pylist(), texts):
                n_words = n = total = 0
                for words, met in word_pieces(text, longest):
                    n_words += len(words) - met
                    for nodes in trie.paths(words, longest, met):
                        n += len(nodes)
                        total += sum([node.gain for node in nodes])
                    if len(trie.nodes) > NODES:
                        trie.clear()
                weight = total // n if n else 0
                out.append((n_words, n, weight, weight + noise(doc_id, seed)))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["id", "n_words", "n_features", "weight", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(score, f"id {kind}, n_words long, n_features long, weight long, score long").withColumnRenamed("id", id_col)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``n_features``, ``weight``, ``score``, ``rank``.

    Words are runs of digits, letters and characters beyond ASCII, A to Z in lower case;
    features are all runs of 1 to ``longest`` words, hashed to ``buckets`` buckets. Of the
    documents with at least ``min_words`` words, ``percent`` in a hundred (rounded down) are
    drawn: those with the highest scores, ties to the smaller id, a null id last. ``rank``
    counts from 1 and is null for rows that are not drawn.

    A null text has no words; a document without features has weight 0. Rows that repeat an
    id are documents of their own. Without any target text all gains come from the smoothing
    alone. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    model = fit_gains(docs, target, longest, buckets, text_col, target_col)
    scored = score_documents(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, seed, "id", "text")
    scored = scratch.write(scored, "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100

    # the position of a row in its range, and the rows of the ranges before; the last column cuts up rows that are alike
    keys = [F.desc("score"), F.asc_nulls_last("id"), F.asc("any")]
    placed = able.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    placed = placed.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    placed = scratch.write(placed, "placed")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = placed.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    cols = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    out = scratch.write(ranked.select(*cols).unionByName(others.select(*cols)), "result", keep=True)
    scratch.clear()
    return out


def drawn_documents(docs: DataFrame, drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, all columns, for tables with one row an id; null ids go."""
    ids = drawn.where(F.col("rank").isNotNull()).select(F.col(id_col).alias("__drawn"))
    return docs.join(ids, docs[id_col] == ids["__drawn"], "left_semi")
