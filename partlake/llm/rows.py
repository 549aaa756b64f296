"""Dropping rows by key, without moving texts where the keys are few."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake.llm.scratch import Scratch

#: Keys up to which they are broadcast (some 40 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 400_000


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores ahead until the table has no such column, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drop_keys(docs: DataFrame, keys: DataFrame, on: dict[str, str], scratch: Scratch) -> DataFrame:
    """``docs`` without the rows whose columns equal a row of ``keys``; ``on`` maps columns of docs to those of keys.

    Nulls equal each other. The keys are written to the scratch folder and counted first.
    """
    kept = scratch.write(keys.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(on.values())]).distinct(), "dropped", keep=True)
    side = F.broadcast(kept) if kept.count() <= BROADCAST_KEYS else kept
    same = reduce(lambda a, b: a & b, (docs[d].eqNullSafe(kept[f"__k_{i}"]) for i, d in enumerate(on)))
    return docs.join(side, same, "left_anti")
