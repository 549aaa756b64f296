"""Sequential loops as window operators."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from partlake.scratch import Scratch

#: Rows that a task of ``chunks_by_size`` holds at once, about 50 bytes each.
RANGE_ROWS = 200_000


def occurrence_labels(df: DataFrame, part: str, label: str, order: list[str]) -> DataFrame:
    """Repeated labels in a group become label, label2, label3 and so on, in order."""
    w = Window.partitionBy(part, label).orderBy(*order)
    n = F.row_number().over(w)
    return df.withColumn("relabelled", F.when(n == 1, F.col(label)).otherwise(F.concat(F.col(label), n.cast("string"))))


def gap_groups(df: DataFrame, part: str, order: Column, gap: float, tie: str) -> DataFrame:
    """A new group starts where the step from the row before is over ``gap``; groups count from 1."""
    w = Window.partitionBy(part).orderBy(order, tie)
    new = F.when(order - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("group_no", F.sum("__new").over(w)).drop("__new")


def cumulative_slots(df: DataFrame, part: str, order: list, amount: str) -> DataFrame:
    """``first`` and ``last`` position that each row takes when amounts are laid end to end."""
    w = Window.partitionBy(part).orderBy(*order)
    last = F.sum(amount).over(w)
    return df.withColumn("last", last).withColumn("first", F.col("last") - F.col(amount) + 1)


def chunks_by_size(df: DataFrame, part: str, order: str, size: Column, limit: int) -> DataFrame:
    """``chunk`` of each row when rows are packed in order and a chunk closes before it passes ``limit``.

    A null size, or one below 0, counts as 0; null parts are one group, a null order comes first.
    The packing restarts with every chunk, which no frame can say. All rows, sorted, are cut
    into ranges of like length, whatever their group. A range is summarised once for every
    amount that its first chunk may already hold; the driver walks over the summaries (a few
    numbers a range) to find what each range really starts with, and the ranges are then
    labelled independently. No task holds more than a range.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "chunks")
    slim = df.select(F.col(part).alias("p"), F.col(order).alias("o"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("s"))
    slim = scratch.write(slim.withColumn("tie", F.monotonically_increasing_id()), "rows")  # equal rows, too, are dealt over ranges
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() // RANGE_ROWS))
    key = ["p", "o", "s", "tie"]
    ranged = slim.repartitionByRange(n, *key).sortWithinPartitions(*key).select("p", "o", "s", F.monotonically_increasing_id().alias("at"))
    ranged = scratch.write(ranged.withColumn("r", F.shiftright("at", 33)), "ranges", keep=True)
    p_type, o_type = slim.schema["p"].dataType.simpleString(), slim.schema["o"].dataType.simpleString()

    def summary(rows: pa.Table) -> pa.Table:
        rows, runs = _runs(rows)
        ps, s = rows["p"], rows["s"].to_numpy()
        out = _summary(s[: runs[1]], limit)
        last = out if len(runs) == 2 else _summary(s[runs[-2] :], limit)
        row = {"r": rows["r"][0].as_py(), "first": ps[0].as_py(), "last": ps[len(ps) - 1].as_py(), "one_run": len(runs) == 2}
        row |= out | {"end_closed": last["zero_closed"], "end_left": last["zero_left"]}
        return pa.Table.from_pylist([row], pa.schema([(f, kinds.get(f, pa.int64())) for f in names]))

    names = ["r", "first", "last", "one_run", "reach", "closed", "left", "total", "zero_closed", "zero_left", "end_closed", "end_left"]
    lists, p_arrow = pa.list_(pa.int64()), to_arrow_type(slim.schema["p"].dataType)
    kinds = {"first": p_arrow, "last": p_arrow, "one_run": pa.bool_(), "reach": lists, "closed": lists, "left": lists}
    types = {"first": p_type, "last": p_type, "one_run": "boolean", "reach": "array<bigint>", "closed": "array<bigint>", "left": "array<bigint>"}
    found = ranged.groupBy("r").applyInArrow(summary, ", ".join(f"{f} {types.get(f, 'bigint')}" for f in names))
    found = scratch.write(found, "summaries")

    entry: dict[int, tuple[int, int]] = {}  # range: what its first chunk holds already, and its number
    used, no, before, some = 0, 0, None, False
    for x in found.orderBy("r").toLocalIterator():
        if not some or x["first"] != before:
            used, no = 0, 0
        entry[x["r"]] = used, no
        if not x["one_run"]:
            used, no = x["end_left"], x["end_closed"]
        elif used == 0:
            used, no = x["zero_left"], no + x["zero_closed"]
        else:
            i = bisect_right(x["reach"], limit - used)
            used, no = (x["left"][i], no + x["closed"][i]) if i < len(x["reach"]) else (used + x["total"], no)
        before, some = x["last"], True
    scratch.clear()

    def label(rows: pa.Table) -> pa.Table:
        rows, runs = _runs(rows)
        s = rows["s"].to_numpy()
        at = entry[rows["r"][0].as_py()]
        chunk = []
        for a, b in zip(runs[:-1], runs[1:]):
            upto, after = _next_starts(s[a:b], limit)
            i, after, starts = _first_start(upto, after, at[0], limit), after.tolist(), []
            while i < b - a:
                starts.append(i)
                i = after[i]
            chunk.append(at[1] + np.searchsorted(starts, np.arange(b - a), side="right"))
            at = 0, 0
        return pa.table({"p": rows["p"], "o": rows["o"], "chunk": pa.array(np.concatenate(chunk), pa.int32())})

    done = ranged.groupBy("r").applyInArrow(label, f"p {p_type}, o {o_type}, chunk int")
    return done.select(F.col("p").alias(part), F.col("o").cast("long").alias(order), "chunk")


def _runs(rows: pa.Table) -> tuple[pa.Table, list[int]]:
    """A range's rows in order, and where a group starts, with the number of rows at the end."""
    rows = rows.take(pc.sort_indices(rows["at"])).combine_chunks()
    code = pc.dictionary_encode(rows["p"], null_encoding="encode").combine_chunks()
    code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
    return rows, [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]


def _next_starts(s: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the sizes before each row and at the end, the row that closes a chunk started at each row)."""
    upto = np.concatenate([[0], np.cumsum(s, dtype=np.int64)])
    over = np.searchsorted(upto, upto[:-1] + limit, side="right") - 1  # the row that passes the limit
    held = upto[np.minimum(over, len(s))] > upto[:-1]  # a chunk that holds nothing yet takes it in
    return upto, np.minimum(np.where(held, over, over + 1), len(s))


def _first_start(upto: np.ndarray, after: np.ndarray, used: int, limit: int) -> int:
    """The first row that closes a chunk which holds ``used`` before the rows."""
    return int(after[0]) if used == 0 else max(0, int(np.searchsorted(upto, limit - used, side="right")) - 1)


def _summary(s: np.ndarray, limit: int) -> dict:
    """Chunks closed in the rows and what the last one holds, for each first row to close a chunk.

    Row i closes first where ``reach[i]``, the sizes up to and with it, is the least that
    passes the limit; rows with the same outcome are one entry. ``zero_``: nothing held before.
    """
    upto, after = _next_starts(s, limit)
    n, last = len(s), np.arange(len(s) + 1)
    jump = np.concatenate([after, [n]])
    jump = np.where(jump == n, last, jump)  # the last start points to itself
    steps = (jump != last).astype(np.int64)
    while (steps_on := steps[jump]).any():
        steps, jump = steps + steps_on, jump[jump]
    row = np.flatnonzero((s > 0) & (upto[:-1] < limit))
    row = row if len(row) and row[0] == 0 else np.concatenate([[0], row])
    closed, left = 1 + steps[row], upto[n] - upto[jump[row]]
    keep = np.append((closed[1:] != closed[:-1]) | (left[1:] != left[:-1]), True)
    zero = int(after[0])
    return {
        "reach": upto[row + 1][keep].tolist(), "closed": closed[keep].tolist(), "left": left[keep].tolist(), "total": int(upto[n]),
        "zero_closed": int(1 + steps[zero]) if zero < n else 0, "zero_left": int(upto[n] - (upto[jump[zero]] if zero < n else 0)),
    }
