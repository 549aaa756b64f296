"""The prefix trie of conversations, in shards of light subtrees.

A node is a distinct sequence of first turns. It is known by its depth and a polynomial
hash of the turns' digests modulo 2^127 - 1, whose base is drawn anew for each run. Such
hashes add up, so a conversation of any length is cut: turns are sorted by ranges, each
task sums its own part, and the parts of a conversation are put together from one row a
task.

Spark counts the nodes (with partial aggregates, so a first turn of a third of all
conversations is a count). A node whose subtree has more than ``shard_rows`` turns is
heavy; heavy nodes are the upper levels. Below them hang the shards, whole subtrees that
fit a task. A task turns its shards into level-order tries (``louds``) and rolls up their
counts from the last level to the first. The upper levels are merged separately: a node
belongs to the conversation with its smallest id, which thus owns the end of its own path;
what a shard or a heavy node adds to the nodes above it is a sum along its owner's path,
and Spark adds up the paths. Nothing passes through the driver.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partlake.llm.louds import Louds
from partlake.llm.scratch import Scratch

PRIME = (1 << 127) - 1
ROOT = bytes(16)
#: Turns below a node from which it counts as heavy.
SHARD_ROWS = 20_000
#: Rows up to which the heavy nodes are broadcast, some 60 bytes each.
BROADCAST_ROWS = 250_000
#: Turns of a path that are summed at once; characters of ids hashed at once.
BLOCK, CHUNK = 4096, 1 << 16


def _int(b: bytes) -> int:
    return int.from_bytes(b, "little")


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "little")


@lru_cache(4096)
def _power(base: int, e: int) -> int:
    return pow(base, e, PRIME)


def _rows(batch: pa.RecordBatch) -> zip:
    return zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _schema(**kinds: str) -> tuple[pa.Schema, str]:
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, arrow[k]) for n, k in kinds.items()]), ", ".join(f"{n} {k}" for n, k in kinds.items())


def _sorted_turns(turns: DataFrame, base: int) -> DataFrame:
    """(conv, part, i, n, prev, upto): turns in order, numbered within their conversation's part, with the hash before and after each."""
    keys = ["conv", F.asc_nulls_first("turn"), "role", "text", "any"]
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = turns.where("conv IS NOT NULL").select("conv", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("any"))
    placed = slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    placed = placed.select("conv", F.spark_partition_id().alias("part"), F.char_length("text").cast("long").alias("n"), F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("digest"))
    schema, kinds = _schema(conv="long", part="int", i="long", n="long", prev="binary", upto="binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, i, total, power = None, 0, 0, 1
            for batch in batches:
                for c, part, n, digest in _rows(batch):
                    if c != conv:
                        conv, i, total, power = c, 0, 0, 1
                    i, power, before = i + 1, power * base % PRIME, total
                    total = (total + _int(digest) * power) % PRIME
                    yield conv, part, i, n, _bytes(before), _bytes(total)

        return _batches(rows(), schema)

    return placed.mapInArrow(scan, kinds)


def _parts(turns: DataFrame, base: int) -> DataFrame:
    """(conv, part, before, at): turns of the conversation in earlier parts, and the hash up to there."""
    ends = turns.groupBy("conv", "part").agg(F.count("*").alias("n"), F.max_by("upto", "i").alias("sum"))
    schema, kinds = _schema(conv="long", part="int", before="long", at="binary", after="long")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, before, at = None, 0, 0
            for batch in batches:
                for c, part, n, total in _rows(batch):
                    if c != conv:
                        conv, before, at = c, 0, 0
                    yield conv, part, before, _bytes(at), before + n
                    at = (at + _int(total) * pow(base, before, PRIME)) % PRIME
                    before += n

        return _batches(rows(), schema)

    return ends.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(fold, kinds)


def _shifted(rows: DataFrame, base: int, kinds: str, passed: list[str]) -> DataFrame:
    """``passed`` columns, with ``parent`` and ``key``: start + (at + base^before * (prev or upto) - less) * base^by."""
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in kinds.split(", "))])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rest = batch.select(passed), batch.select([c for c in batch.schema.names if c not in passed])
            parent, key = [], []
            for prev, upto, before, at, less, start, by in _rows(rest):
                a, p, q, s = _int(at) - _int(less), _power(base, before), _power(base, by), _int(start)
                parent.append(_bytes((s + (a + p * _int(prev)) * q) % PRIME))
                key.append(_bytes((s + (a + p * _int(upto)) * q) % PRIME))
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(parent, pa.binary()), pa.array(key, pa.binary())], schema=schema)

    return rows.select(*passed, "prev", "upto", "before", "at", "less", "start", "by").mapInArrow(shift, kinds)


def branched_paths(conversations: DataFrame, scratch: Scratch, every: int, heads: int) -> DataFrame:
    """(conv, d, key, parent, n, length): each turn of each rebuilt conversation, and its root (d = 0)."""
    base = random.SystemRandom().randrange(2, PRIME)
    turns = scratch.write(_sorted_turns(conversations, base), "turns")
    parts = scratch.write(_parts(turns, base), "parts")
    root = F.lit(ROOT)

    # the first turns of each conversation, of which others may begin
    zero = F.lit(0).cast("long")
    first = turns.where(F.col("i") < heads).join(parts, ["conv", "part"]).withColumn("pos", F.col("before") + F.col("i")).where(F.col("pos") < heads)
    first = first.select("*", root.alias("less"), root.alias("start"), zero.alias("by"))
    first = _shifted(first, base, "conv long, pos long, n long, parent binary, key binary", ["conv", "pos", "n"])
    first = scratch.write(first, "first")
    convs = parts.groupBy("conv").agg(F.max("after").alias("total"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("long")
    convs = convs.select("conv", "total", (F.col("conv") - F.col("conv") % every).alias("from"), h.alias("h"))
    totals = convs.select(F.col("conv").alias("from"), F.col("total").alias("there"))
    convs = convs.join(totals, "from", "left").withColumn("k", F.least("h", F.coalesce("there", zero)))
    start = first.select(F.col("conv").alias("from"), F.col("pos").alias("k"), F.col("key").alias("start"))
    less = first.select("conv", F.col("pos").alias("h"), F.col("key").alias("less"))
    convs = convs.join(start, ["from", "k"], "left").join(less, ["conv", "h"], "left")
    length = F.col("k") + F.greatest(F.col("total") - F.col("h"), zero)
    convs = convs.select("conv", "from", "h", "k", F.coalesce("start", root).alias("start"), F.coalesce("less", root).alias("less"), length.alias("length"))
    convs = scratch.write(convs, "conversations")

    cols = ["conv", "d", "key", "parent", "n", "length"]
    begun = convs.select("conv", F.lit(0).cast("long").alias("d"), root.alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("n"), "length")
    f = first.withColumnRenamed("conv", "from")
    taken = convs.where("k > 0").select("conv", "from", "k", "length").join(f, "from").where(F.col("pos") <= F.col("k")).withColumnRenamed("pos", "d")
    # a long conversation lies in many parts, so this join has no hot key
    about = parts.select("conv", "part", "before", "at").join(convs, "conv")
    own = turns.join(about, ["conv", "part"]).where(F.col("before") + F.col("i") > F.col("h"))
    own = own.withColumn("by", F.col("k") - F.col("h")).withColumn("d", F.col("before") + F.col("i") + F.col("by"))
    own = _shifted(own, base, "conv long, d long, n long, length long, parent binary, key binary", ["conv", "d", "n", "length"])
    return begun.select(*cols).unionByName(taken.select(*cols)).unionByName(own.select(*cols))


def _ends(paths: DataFrame) -> DataFrame:
    """(d, key, ends_sha256) of the nodes at which conversations end: the ids in order are packed by ranges, then hashed as a stream."""
    ends = paths.where(F.col("d") == F.col("length")).select("d", "key", "conv")
    packed_schema, packed = _schema(d="long", key="binary", part="int", no="long", ids="string")
    hashed_schema, hashed = _schema(d="long", key="binary", ends_sha256="string")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, part, no, held, size = None, 0, 0, [], 0
            for batch in batches:
                for d, key, conv, p in _rows(batch):
                    if (d, key) != at or size > CHUNK:
                        if held:
                            yield *at, part, no, ",".join(held)
                        at, part, no, held, size = (d, key), p, no + 1, [], 0
                    held.append(str(conv))
                    size += len(held[-1]) + 1
            if held:
                yield *at, part, no, ",".join(held)

        return _batches(rows(), packed_schema, 200)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, sha = None, None
            for batch in batches:
                for d, key, _, _, ids in _rows(batch):
                    if (d, key) != at:
                        if at:
                            yield *at, sha.hexdigest()
                        at, sha = (d, key), hashlib.sha256()
                    else:
                        sha.update(b",")
                    sha.update(ids.encode())
            if at:
                yield *at, sha.hexdigest()

        return _batches(rows(), hashed_schema)

    ends = ends.repartitionByRange("d", "key", "conv").sortWithinPartitions("d", "key", "conv")
    chunks = ends.withColumn("part", F.spark_partition_id()).mapInArrow(pack, packed)
    return chunks.repartition("d", "key").sortWithinPartitions("d", "key", "part", "no").mapInArrow(digest, hashed)


def _shards(light: DataFrame, shard_rows: int) -> DataFrame:
    """Roll-ups of the light nodes, each with its parent's conversation (null for the root of a shard)."""
    schema, kinds = _schema(
        d="long", key="binary", conv="long", n_convs="long", parent="binary", parent_conv="long", n_children="long", n_leaves="long", saved="long"
    )

    def rolled(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rd, d, n, n_convs, conv = (np.array(c, np.int64) for c in zip(*[(r[0], r[2], r[5], r[6], r[7]) for r in rows]))
        place = {(r[2], r[3]): i for i, r in enumerate(rows)}
        parent = np.array([-1 if r[2] == r[0] else place[r[2] - 1, r[4]] for r in rows], np.int64)
        trie, order = Louds.of(parent, d - rd, np.arange(len(rows)))
        degree = trie.degrees()
        leaves, saved = trie.rollup(degree == 0, ((n_convs - 1) * n)[order])
        above, ids = trie.parents(), conv[order]
        arrays = [
            pa.array(d[order]),
            pa.array([rows[i][3] for i in trie.labels], pa.binary()),
            pa.array(ids),
            pa.array(n_convs[order]),
            pa.array([rows[i][4] for i in trie.labels], pa.binary()),
            pa.array(ids[above], mask=above < 0),
            pa.array(degree),
            pa.array(leaves),
            pa.array(saved),
        ]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in _rows(batch):
                if len(held) >= shard_rows and row[:2] != held[-1][:2]:  # whole shards, in order
                    yield from rolled(held)
                    held = []
                held.append(row)
        if held:
            yield from rolled(held)

    dealt = light.select("rd", "rkey", "d", "key", "parent", "n", "n_convs", "conv").repartition("rd", "rkey").sortWithinPartitions("rd", "rkey", "d", "conv")
    return dealt.mapInArrow(build, kinds)


def _sums_below(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the sums of ``cols`` from each row of a conversation to its last, block by block."""
    df = df.withColumn("block", F.col("d") - F.col("d") % BLOCK)
    per = df.groupBy("conv", "block").agg(*[F.sum(c).alias(f"b_{c}") for c in cols])
    later = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("conv", "block", *[F.coalesce(F.sum(f"b_{c}").over(later), F.lit(0)).alias(f"b_{c}") for c in cols])
    within = Window.partitionBy("conv", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.select("conv", "d", "key", "block", *[F.sum(c).over(within).alias(c) for c in cols]).join(per, ["conv", "block"])
    return sums.select("conv", "d", "key", *[(F.col(c) + F.col(f"b_{c}")).alias(c) for c in cols])


def conversation_trie(
    conversations: DataFrame,
    every: int = 100,
    heads: int = 6,
    shard_rows: int = SHARD_ROWS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Conversations are ordered by turn (null first; rows of one turn by role, then text) and
    rebuilt: the first h turns of conversation c - c % every (fewer if it has fewer, none if
    it is absent), then the turns of c after its first h, with h the CRC-32 of c in decimals
    modulo ``heads``. The remainder of a negative id is negative. A null role or text is
    empty. Repeated rows are turns of their own.

    A node is a distinct sequence (role, text) of first turns, from the empty one; its
    members are the rebuilt conversations that begin with it, those without any turn
    included. ``conv_id`` is the smallest member, ``n_leaves`` counts nodes without children
    in the subtree, ``saved_tokens`` adds up (members - 1) times the code points of the last
    text, and ``ends_sha256`` hashes the ids of members that end here.

    Ids are integers; rows without one are in no conversation and are left out. An empty
    table gives no rows, not even a root. Other columns are not read.
    """
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    slim = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    paths = scratch.write(branched_paths(slim, scratch, every, heads), "paths")
    nodes = paths.groupBy("d", "key").agg(
        F.count("*").alias("n_convs"),
        F.min("conv").alias("conv"),
        F.first("parent").alias("parent"),
        F.first("n").alias("n"),
        F.sum(F.col("length") - F.col("d") + 1).alias("below"),
    )
    nodes = scratch.write(nodes, "nodes")
    is_heavy = (F.col("below") > shard_rows) | (F.col("d") == 0)
    saves = (F.col("n_convs") - 1) * F.col("n")
    ends_all = (F.col("below") == F.col("n_convs")).cast("long")  # no member goes on
    heavy = scratch.write(nodes.where(is_heavy).select("d", "key", "conv", "n_convs", "parent", saves.alias("saved"), ends_all.alias("leaf")), "heavy")
    h = heavy.select("d", "key", F.col("conv").alias("owner"), "saved", "leaf")
    h = F.broadcast(h) if h.count() <= broadcast_rows else h
    flagged = paths.select("conv", "d", "key").join(h, ["d", "key"], "left")

    # the shard of a conversation's light nodes is the first of them
    shard = flagged.where("owner IS NULL").groupBy("conv").agg(F.min(F.struct("d", "key")).alias("s")).select("conv", F.col("s.d").alias("rd"), F.col("s.key").alias("rkey"))
    light = scratch.write(_shards(nodes.where(~is_heavy).join(shard, "conv"), shard_rows), "light")
    tops = light.where("parent_conv IS NULL")

    # what shards and heavy nodes add to the nodes above, along the paths of those that own them
    added = tops.select("conv", "d", F.lit(None).cast("binary").alias("key"), "saved", F.col("n_leaves").alias("leaf"))
    owners = heavy.select("conv").union(tops.select("conv")).distinct()
    mine = F.col("owner") == F.col("conv")
    above = flagged.where("owner IS NOT NULL").join(owners, "conv", "left_semi")
    above = above.select("conv", "d", "key", *[F.when(mine, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("saved", "leaf")])
    sums = _sums_below(above.unionByName(added), ["saved", "leaf"]).where("key IS NOT NULL")
    sums = sums.groupBy("d", "key").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("n_leaves"))
    children = heavy.where("d > 0").select("d", "parent").union(tops.select("d", "parent"))
    children = children.groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    upper = heavy.select("d", "key", "conv", "n_convs", "parent").join(sums, ["d", "key"]).join(children, ["d", "key"], "left")
    upper = upper.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("parent_conv", F.lit(None).cast("long"))

    names = heavy.select((F.col("d") + 1).alias("d"), F.col("key").alias("parent"), F.col("conv").alias("above"))
    names = F.broadcast(names) if names.count() <= broadcast_rows else names
    found = light.unionByName(upper).join(names, ["d", "parent"], "left").join(_ends(paths), ["d", "key"], "left")
    out = found.select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.coalesce("parent_conv", "above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    out = scratch.write(out, "result", keep=True)
    scratch.clear()
    return out
