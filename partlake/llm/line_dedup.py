"""Dropping lines that several documents hold.

Lines are exploded with their positions, normalised and hashed; the distinct documents of
each hash are counted with partial aggregates, so a line in a third of all documents is a
few counts a task. The hashes over the threshold, each with the first document that holds
it, meet the lines again: by broadcast where they were counted and are few, else by a
shuffled join, which adaptive execution splits where a line is hot. Only positions travel
back to the documents, which are put together from the stretches between them.

DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.llm.scratch import Scratch

#: What is stripped at both ends of a line: space and U+0009 to U+000D.
ENDS = " \t\n\x0b\x0c\r"
#: Repeated lines up to which they are broadcast (some 80 bytes each).
BROADCAST_LINES = 250_000


def lines_of(text: Column) -> Column:
    """The lines of a text, cut at each line feed; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A to Z in lower case."""
    s = F.btrim(line, F.lit(ENDS))
    # lower() changes A to Z alone in lines of ASCII and lower-case letters; others go letter by letter
    plain = (F.octet_length(s) == F.char_length(s)) | ~s.rlike(r"[^\x00-\x7F\p{Ll}]")
    return F.when(plain, F.lower(s)).otherwise(F.translate(s, string.ascii_uppercase, string.ascii_lowercase))


def _digest(key: Column) -> Column:
    """128 bits of SHA-256: keys with one digest are taken as equal."""
    return F.unhex(F.substring(F.sha2(key.cast("binary"), 256), 1, 32))


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, row, pos, digest) of each line that is long enough."""
    lines = docs.select("id", "row", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = lines.where(F.char_length(F.btrim("line", F.lit(ENDS))) >= min_chars)
    return lines.select("id", "row", "pos", _digest(line_key(F.col("line"))).alias("digest"))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(digest, ``first``, ``n_docs``) of digests in at least ``min_docs`` documents; ``first`` is the smallest id, null only where no other holds it."""
    n = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    return lines.groupBy("digest").agg(F.min("id").alias("first"), n.alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """One row per input row: id, ``n_lines``, ``n_dropped``, ``kept`` (the lines that stay, joined by line feeds).

    A line's key is the line without space and U+0009 to U+000D at both ends, A to Z in
    lower case. Keys of at least ``min_chars`` code points in at least ``min_docs`` documents
    lose all their lines but those in the document with the smallest id that holds them.

    Documents are told apart by their id: rows that repeat an id, and rows without one, count
    as one document, so none of them loses a line to another; a null id comes after all
    others. A null or empty text is one empty line. A text whose lines all go becomes empty.
    An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    slim = slim.withColumn("row", F.xxhash64("text"))
    lines = _keyed_lines(slim, min_chars)
    repeated = scratch.write(repeated_lines(lines, min_docs).select("digest", "first"), "repeated")
    side = F.broadcast(repeated) if repeated.count() <= broadcast_lines else repeated
    dropped = lines.join(side, "digest").where(~F.col("id").eqNullSafe(F.col("first")))
    # rows equal in id and text lose the same positions
    places = dropped.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))

    d, p = slim.alias("d"), places.alias("p")
    both = d.join(p, F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.row") == F.col("p.row")), "left")
    out = both.select(F.col("d.id").alias("id"), "text", lines_of(F.col("text")).alias("lines"), "gone").select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_between("lines", "gone"), "\n")).alias("kept"),
    )
    out = scratch.write(out, "result", keep=True)
    scratch.clear()
    return out


def _between(lines: str, gone: str) -> Column:
    """The elements of ``lines`` whose positions are not in the ascending ``gone``: the stretches between them, each cut once."""
    ends = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.flatten(F.transform(spans, lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"])))
