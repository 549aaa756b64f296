"""Repeated byte strings by a logarithmic family of sparse suffix indexes (hashed prefixes with counts, no positions).

A suffix array of all bytes would be many times the corpus. Equal long strings hold
equal anchors (see ``anchors``), so only the suffixes that start at an anchor are
indexed, in the order of the hash of their first ``gram`` bytes: an order in which
suffixes that agree on these bytes stand together, which is all that a scan for long
matches needs. An index is kept as runs of equal prefixes with their number; it is not a
suffix array, and matches are found again in the texts.

The corpus comes in batches. A new batch gets its index, which is merge-scanned against
every existing level for prefixes that occur on both sides, then becomes a level
itself; two levels of equal rank merge into one of the next rank. With b batches there
are at most log2(b) + 1 levels, and a suffix is rewritten as often.

Prefixes that repeat name the anchors whose surroundings can repeat. A surrounding that
occurs twice as a whole is settled by its hash; of the others, each distinct one is
compared string by string. Every step groups by content hashes with partial counts or
joins by them, so a passage in a third of all documents is a count, never a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake.llm.anchors import STRETCH, Hasher, find_anchors
from partlake.llm.batches import slices_by_bytes, text_batches
from partlake.llm.scratch import Scratch

LENGTH, GRAM = 200, 96
#: Bytes hashed at once: the arrays of a piece stay within a few megabytes.
PIECE = 1 << 18
#: Bytes up to which a per-document table is broadcast to the documents; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _buffers(batch: pa.RecordBatch, col: int, length: int) -> Iterator[tuple[Hasher, np.ndarray, np.ndarray, np.ndarray]]:
    """(hasher, rows, (start, end) in the buffer, offset in the document) for stretches of a batch's texts."""
    i = 0
    for part in slices_by_bytes(batch, col, PIECE):
        raw = part.column(col).cast(pa.large_binary()).to_pylist()
        held: list[bytes] = []
        rows: list[int] = []
        offs: list[int] = []
        for k, b in enumerate(raw):
            if len(b) <= STRETCH:
                held.append(b)
                rows.append(i + k)
                offs.append(0)
                continue
            for x in range(0, len(b) - length + 1, STRETCH):  # strings start in one stretch each
                cut = b[x : x + STRETCH + length - 1]
                yield Hasher(cut), np.array([i + k]), np.array([[0, len(cut)]]), np.array([x])
        if held:
            n = np.array([len(b) for b in held], np.int64)
            start = np.cumsum(n + 1) - n - 1
            yield Hasher(b"\0".join(held)), np.array(rows), np.stack([start, start + n], axis=1), np.array(offs)
        i += part.num_rows


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _keys(slim: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, n): the prefixes of anchored suffixes, counted within a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, _, bounds, _ in _buffers(b, 0, length):
                key, n = np.unique(find_anchors(h, bounds, length, gram)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], names=["key", "n"])

    return text_batches(slim).select("text").mapInArrow(run, "key long, n int")


def _surroundings(slim: DataFrame, length: int, gram: int, id_kind: str) -> DataFrame:
    """(id, row, key, around, lo, hi): each anchor with the first and last start of the strings that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, rows, bounds, offs in _buffers(b, 2, length):
                own, at, key, lo, hi = find_anchors(h, bounds, length, gram)
                around = h.substrings(lo, hi + length) + (at - lo).astype(np.uint64)
                shift = offs[own] - bounds[own, 0]
                take = pa.array(rows[own])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(take),
                        b.column(1).take(take),
                        pa.array(key.view(np.int64)),
                        pa.array(around.view(np.int64)),
                        pa.array((lo + shift).astype(np.int32)),
                        pa.array((hi + shift).astype(np.int32)),
                    ],
                    names=["id", "row", "key", "around", "lo", "hi"],
                )

    return slim.select("id", "row", "text").mapInArrow(run, f"id {id_kind}, row long, key long, around long, lo int, hi int")


def _strings(with_spans: DataFrame, length: int, id_kind: str) -> DataFrame:
    """(id, row, start, string, one): hash of every string that starts in the given spans (lo, hi, one) of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(3)
            for k in range(b.num_rows):
                h = Hasher(b.column(2)[k].as_py().encode("utf-8", "surrogatepass"))
                s = spans[k].values
                lo, hi = s.field("lo").to_numpy().astype(np.int64), s.field("hi").to_numpy().astype(np.int64)
                one = s.field("one").to_numpy(zero_copy_only=False)
                n = hi - lo + 1
                start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
                m = len(start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column(0)[k].as_py()] * m, b.column(0).type),
                        pa.array(np.full(m, b.column(1)[k].as_py(), np.int64)),
                        pa.array(start.astype(np.int32)),
                        pa.array(h.substrings(start, start + length).view(np.int64)),
                        pa.array(np.repeat(one, n)),
                    ],
                    names=["id", "row", "start", "string", "one"],
                )

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for out in run(batches):  # small documents leave as one batch
            held.append(out)
            rows += out.num_rows
            if rows >= 100_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return with_spans.select("id", "row", "text", "spans").mapInArrow(
        grouped, f"id {id_kind}, row long, start int, string long, one boolean"
    )


class LevelFamily:
    """Levels of a growing index: (rank, table of key and n), at most one of each rank."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch's array (key, n) in; returns its keys that repeat, in it or in an existing level."""
        again = batch.where("n > 1").select("key")
        for _, level in self.levels:
            again = again.unionByName(batch.join(level.select("key"), "key", "left_semi").select("key"))
        again = self.scratch.write(again, "repeats")
        self.levels.append((0, batch))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy("key").agg(F.sum("n").cast("int").alias("n")).sortWithinPartitions("key")
            merged = self.scratch.write(merged, f"level{rank + 1}")
            self.scratch.drop(a, b)
            self.levels.append((rank + 1, merged))
        return again


def repeated_spans(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    batches: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """(id, row, ``spans`` array of (lo, hi)): the maximal runs of repeated bytes, of documents that have any.

    ``row`` is the hash of the text, by which rows that repeat an id are told apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix-dedup")
    slim = _slim(docs, id_col, text_col).where(F.octet_length("text") >= length)
    kind = docs.schema[id_col].dataType.simpleString()
    family, repeats = LevelFamily(scratch), []
    for b in range(batches):
        batch = slim.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b)
        counted = _keys(batch, length, gram).groupBy("key").agg(F.sum("n").cast("int").alias("n"))
        repeats.append(family.add(scratch.write(counted.sortWithinPartitions("key"), f"batch{b}")))
    scratch.drop(*[t for _, t in family.levels])
    known = repeats[0]
    for r in repeats[1:]:
        known = known.unionByName(r)

    # a plain sort-merge join of two tables: adaptive execution splits a prefix that very many places share
    known = scratch.write(known.distinct(), "known")
    scratch.drop(*repeats)
    found = scratch.write(_surroundings(slim, length, gram, kind).join(known, "key", "left_semi"), "surroundings")
    scratch.drop(known)
    kinds = scratch.write(
        found.groupBy("key", "around").agg(F.count("*").alias("c"), F.min(F.struct("id", "row", "lo", "hi")).alias("at")), "kinds"
    )
    whole = found.join(kinds.where("c > 1").select("key", "around"), ["key", "around"], "left_semi")
    whole = whole.select("id", "row", "lo", (F.col("hi") + length).alias("hi"))

    # surroundings that occur once, and one of each other kind that shares their prefix
    mixed = kinds.groupBy("key").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 AND least = 1").select("key")
    asked = kinds.join(mixed, "key", "left_semi").select("at.id", "at.row", F.struct("at.lo", "at.hi", (F.col("c") == 1).alias("one")).alias("s"))
    asked = scratch.write(asked.groupBy("id", "row").agg(F.collect_list("s").alias("spans"), F.count("*").alias("n")), "asked")
    weight = asked.agg(F.sum(F.col("n") * 9 + 40)).first()[0] or 0
    strings = _strings(_join_texts(slim, asked, weight), length, kind)
    strings = scratch.write(strings, "strings")
    twice = strings.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select("string")
    parts = strings.where("one").join(twice, "string", "left_semi").select("id", "row", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))

    covered = whole.unionByName(parts).repartition("id", "row").sortWithinPartitions("id", "row", "lo", "hi")
    runs = covered.mapInArrow(_merge_runs, f"id {kind}, row long, lo int, hi int")
    return scratch.write(runs.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "spans")


def _join_texts(slim: DataFrame, spans: DataFrame, weight: int, how: str = "inner") -> DataFrame:
    side = F.broadcast(spans) if weight <= BROADCAST_BYTES else spans
    return slim.join(side, slim["id"].eqNullSafe(spans["id"]) & (slim["row"] == spans["row"]), how).select(slim["*"], spans["spans"])


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted intervals to maximal runs; the open run is carried over batches."""
    open_: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        row, lo, hi = b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
        ids = b.column(0).dictionary_encode()
        code = ids.indices.fill_null(-1).to_numpy() if ids.indices.null_count else ids.indices.to_numpy()
        doc = np.cumsum(np.concatenate([[False], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
        far = np.maximum.accumulate(hi + doc * (1 << 32)) - doc * (1 << 32)
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > far[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(lo)]]) - 1
        runs = [(b.column(0)[int(i)].as_py(), int(row[i]), int(lo[i]), int(far[j])) for i, j in zip(first, last)]
        if open_ is not None:
            # the first document of this batch may go on from the last one
            k = 0
            while k < len(runs) and runs[k][:2] == open_[:2] and runs[k][2] <= open_[3]:
                open_ = (*open_[:3], max(open_[3], runs[k][3]))
                k += 1
            runs = [open_, *runs[k:]]
        open_ = runs.pop()
        yield _runs_batch(runs, b.column(0).type)
    if open_ is not None:
        yield _runs_batch([open_], b.column(0).type)


def _runs_batch(runs: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*runs)) or [(), (), (), ()]
    kinds = [id_type, pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "row", "lo", "hi"])


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    batches: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` binary) for every row.

    Removed is each byte covered by a ``length``-byte string that also starts anywhere else
    in the table, in the same document included. Texts count as UTF-8, null as empty;
    matches never cross rows; strings are judged on the input. ``n_spans`` counts maximal
    removed runs. Every copy of a repeated string goes, the first one too; a row that
    repeats another loses all of a text of ``length`` bytes or more. Shorter texts stay. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    spans = repeated_spans(docs, length, gram, batches, id_col, text_col, scratch)
    weight = spans.agg(F.sum(F.size("spans") * 8 + 40)).first()[0] or 0
    slim = _slim(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices_by_bytes(batch, 1)):
            size, gone, n, kept = [], [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                out, at = [], 0
                for x in s or []:
                    out.append(raw[at : x["lo"]])
                    at = x["hi"]
                out.append(raw[at:])
                kept.append(b"".join(out))
                size.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                n.append(len(s or []))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, n)), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = _join_texts(slim, spans, weight, "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
