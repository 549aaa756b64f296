"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from partlake.llm.batches import slices_by_bytes, text_batches

#: Texts above this many characters are encoded piece by piece, so one text never needs all its ids as Python objects.
PIECE_CHARS = 1 << 16

#: A match never runs from a visible character into white space: a token has white
#: space at its front or nowhere. So the place before a white-space character that
#: follows a visible one is a boundary between matches in every text.
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def load_encoding(rank_file: str, pattern: str):
    """The encoding of a rank file (``base64 rank`` lines), without special tokens; cached in each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_safely(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text into pieces of ``size`` characters or more, at safe boundaries only; joined they are the text."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_runs(enc, text: str) -> Iterator[np.ndarray]:
    """Ids of a piece without a safe boundary, match by match.

    The library's pattern engine keeps a state for each character of a white-space run and
    gives up on very long ones; here the matches are found first, and each is merged by itself,
    which is what the library does with it.
    """
    for m in regex.compile(enc._pat_str).finditer(text):
        yield np.asarray(enc._encode_single_piece(m.group()), dtype="<u4")


def encode_text(enc, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    if not text:
        return np.zeros(0, "<u4")
    out: list[np.ndarray] = []
    for p in split_safely(text, size):
        if len(p) <= 2 * size:
            out.append(np.asarray(enc.encode_ordinary(p), dtype="<u4"))
            continue
        held: list[np.ndarray] = []
        for ids in encode_runs(enc, p):  # joined now and then: matches may be short and many
            held.append(ids)
            if len(held) == 4096:
                out.append(np.concatenate(held))
                held.clear()
        out += held
    return np.concatenate(out)


def decode_ids(enc, ids: np.ndarray, size: int = 1 << 18) -> bytes:
    """The raw bytes of ids; a token may hold part of a character, so bytes are joined before any text is made."""
    return b"".join(enc.decode_bytes(ids[i : i + size].tolist()) for i in range(0, len(ids), size))


def encode_column(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ``ids`` binary): each text's token ids as little-endian unsigned 32-bit integers.

    Null and empty texts give empty binaries. Each row is treated by itself: repeated
    ids and texts stay as they are, other columns are not read. Texts of any length are
    encoded whole, long runs of blanks, letters or signs among them; an empty table gives no rows. ``rank_file`` must be readable at the same path on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(rank_file, pattern)
        for b in batches:
            for part in slices_by_bytes(b, 1):
                out = [encode_text(enc, t or "").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=[id_col, "ids"])

    return text_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode_column(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ``ids``, ``decoded`` binary): the raw bytes behind each row's ids. Ids outside the vocabulary raise."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(rank_file, pattern)
        for b in batches:
            for part in slices_by_bytes(b, 1, 2 << 20):
                ids = [np.frombuffer(x or b"", "<u4") for x in part.column(1).to_pylist()]
                out = [decode_ids(enc, i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"]
                )

    return text_batches(encoded).select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def round_trip_column(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ``ids``, ``decoded``) as by ``encode_column`` and then ``decode_column``, in one pass over the texts.

    One Python worker a task holds the vocabulary instead of two. Same results for nulls,
    empty and long texts, repeated rows and empty tables.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(rank_file, pattern)
        for b in batches:
            for part in slices_by_bytes(b, 1, 2 << 20):
                ids = [encode_text(enc, t or "") for t in part.column(1).to_pylist()]
                out = [decode_ids(enc, i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(out, pa.binary())],
                    names=[id_col, "ids", "decoded"],
                )

    return text_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")
