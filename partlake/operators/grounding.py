"""Finding many signatures in many texts: one automaton, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake.scratch import Scratch

#: Signatures of one automaton; more are searched in several passes.
BLOCK = 100_000


def found_in(texts: DataFrame, vendor: str, text: str, signs: list[tuple[str | None, str]]) -> DataFrame:
    """(vendor, sign, n): in how many texts of its vendor each sign stands; a row a task and pair that is found."""
    vendors_of: dict[str, set] = {}
    for v, s in signs:
        vendors_of.setdefault(s, set()).add(v)
    kind = texts.schema[vendor].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for s in vendors_of:
            automaton.add_word(s, s)
        automaton.make_automaton()
        n: dict[tuple, int] = {}
        for batch in batches:
            for v, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in {s for _, s in automaton.iter(t)} if t and vendors_of else ():
                    if v in vendors_of[s]:
                        n[v, s] = n.get((v, s), 0) + 1
        rows = list(n)
        vendors = pa.array([v for v, _ in rows], batch_type)
        yield pa.RecordBatch.from_arrays([vendors, pa.array([s for _, s in rows], pa.string()), pa.array([n[k] for k in rows], pa.int64())], names=["vendor", "sign", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(texts.schema[vendor].dataType)
    return texts.select(vendor, text).mapInArrow(search, f"vendor {kind}, sign string, n long")


def grounded(signatures: DataFrame, texts: DataFrame, vendor: str, signature: str, text: str, ignore_case: bool = False, block: int = BLOCK) -> DataFrame:
    """(vendor, signature, ``n_texts``): in how many of a vendor's texts a signature stands.

    Every different (vendor, signature) has a row, 0 where no text holds it. A signature that is
    null or empty stands in no text. Texts are read where they lie, once for each ``block``
    signatures; what is shuffled are counts. Null vendors are one vendor.
    """
    scratch = Scratch(signatures.sparkSession, "grounded")
    form = F.upper if ignore_case else (lambda c: c)
    asked = scratch.write(signatures.select(F.col(vendor), F.col(signature), form(F.col(signature)).alias("__sign")).distinct(), "signatures", keep=True)
    read = texts.select(F.col(vendor), form(F.col(text)).alias("__text"))
    real = asked.where("__sign <> ''").select(vendor, "__sign").distinct()
    blocks = max(1, -(-real.count() // block))
    parts = []
    for i in range(blocks):
        some = real.where(F.pmod(F.xxhash64("__sign"), F.lit(blocks)) == i)
        parts.append(found_in(read, vendor, "__text", [tuple(r) for r in some.collect()]))  # about a block of signatures
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    counts = found.groupBy("vendor", "sign").agg(F.sum("n").alias("n_texts"))
    same = asked[vendor].eqNullSafe(counts["vendor"]) & (asked["__sign"] == counts["sign"])
    return asked.join(counts, same, "left").select(asked[vendor], asked[signature], F.coalesce("n_texts", F.lit(0).cast("long")).alias("n_texts"))
