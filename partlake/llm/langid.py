"""Language identification by rank-order n-gram profiles.

A profile is the list of a text's most frequent character n-grams (one to three
letters, words padded by one blank) in order of frequency. The distance of a
document to a language is the sum, over the document's profile, of how far each
n-gram is out of place in the language's profile; one that is missing there counts
as the profile's length. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partlake.llm.batches import slices_by_bytes, text_batches

#: N-grams kept in a profile.
PROFILE = 300
UNKNOWN = "und"
#: Letters of a text whose n-grams are listed at once.
PIECE = 1 << 18

_BITS = 21  # a code point
_lower: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Table: code point to its lower-case letter, 32 for everything that is no letter."""
    global _lower
    if _lower is None:
        table = np.full(0x110000, 32, np.int32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _lower = table
    return _lower


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the whole text's n-grams; a code packs up to three letters. Empty without letters."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    a = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not (a != 32).any():
        return none
    a = np.concatenate([[np.int32(32)], a, [np.int32(32)]])
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]  # one blank between words
    parts = []
    for i in range(0, len(a), PIECE):  # n-grams start in one piece each; the counts of pieces add up
        x = a[i : i + PIECE + 2].astype(np.int64)
        one = x[:PIECE][x[:PIECE] != 32]
        two = (x[: PIECE + 1][:-1] << _BITS) | x[1 : PIECE + 1]
        three = (x[:-2] << (2 * _BITS)) | (x[1:-1] << _BITS) | x[2:]
        three = three[x[1:-1] != 32]  # no n-gram over two words
        parts.append(np.unique(np.concatenate([one, two, three]), return_counts=True))
    return _add(parts)


def has_letters(text: str | None) -> bool:
    return bool(text) and bool((_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)] != 32).any())


def top_ranks(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    if len(codes) > 4 * size:  # only codes at or above the size-th count can be among them
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= cut
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(``lang``, ``rank`` from 0, ``code``): each language's profile, from every row with a language and a text.

    Counts cover all rows: partitions count for themselves, one shuffle adds the counts
    up. Languages without letters get no profile.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        grown = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = _add(parts)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(codes), pa.string()), "code": codes, "n": counts}
                )
            held.clear()

        for b in (s for batch in batches for s in slices_by_bytes(batch, 0)):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes, counts = ngram_counts(text)
                held.setdefault(lang, []).append((codes, counts))
                grown += len(codes)
                if grown > 2_000_000:
                    for k in held:
                        held[k] = [_add(held[k])]
                    grown = sum(len(v[0][0]) for v in held.values())
                    if grown > 1_000_000:  # many languages or alphabets: pass on what there is
                        yield from flush()
                        grown = 0
        yield from flush()

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    total = text_batches(labelled).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return (
        total.withColumn("rank", (F.row_number().over(place) - 1).cast("int"))
        .where(F.col("rank") < size)
        .select("lang", "rank", "code")
    )


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)


class Profiles:
    """The languages' profiles as one sorted code table; a few hundred rows a language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        self.codes = np.unique(np.array([r[2] for r in rows], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)  # the last row: unknown everywhere
        for lang, rank, code in rows:
            self.ranks[np.searchsorted(self.codes, code), at[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): 1 for equal profiles, 0 for nothing in common; ``und`` and 0 without letters or languages."""
        codes, counts = ngram_counts(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        top = top_ranks(codes, counts, self.size)
        if len(self.codes):
            i = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
            i = np.where(self.codes[i] == top, i, len(self.codes))
        else:
            i = np.zeros(len(top), np.int64)
        ranks = self.ranks[i]
        far = np.where(ranks < 0, self.size, np.minimum(self.size, np.abs(ranks - np.arange(len(top))[:, None])))
        dist = far.sum(axis=0)
        best = int(np.argmin(dist))
        return self.langs[best], float(1 - dist[best] / (self.size * len(top)))


def predict_languages(
    docs: DataFrame,
    profiles: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = PROFILE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, ``keep`` columns, ``lang_pred``, ``score``, ``has_letters``) for every row, from the text alone.

    Null texts and texts without a letter get ``und`` and 0. Ties go to the language
    that sorts first. Rows are independent: repeated ids stay, columns not named are not
    read; without any profile every row is ``und``, and only ``has_letters`` tells texts
    that no language could have. Whole texts count, however long.
    """
    model = Profiles([tuple(r) for r in profiles.select("lang", "rank", "code").collect()], size)
    cols = [id_col, *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices_by_bytes(batch, 0)):
            texts = b.column(0).to_pylist()
            said = [model.predict(t) for t in texts]
            known = [x[0] != UNKNOWN or has_letters(t) for x, t in zip(said, texts)]
            more = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array(known, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *more], names=[*cols, "lang_pred", "score", "has_letters"])

    own = "__text"
    while own in cols:
        own = "_" + own
    return text_batches(docs).select(F.col(text_col).alias(own), *cols).mapInArrow(run, f"{schema}, lang_pred string, score double, has_letters boolean")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Rows kept from learning: the crc32 of the id's text is divisible by ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0
