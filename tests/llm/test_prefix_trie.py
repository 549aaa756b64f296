"""The conversation trie against a plain version, with nulls, ties, repeats, hot and long conversations and clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from partlake.llm import prefix_trie
from partlake.llm.louds import Louds

SCHEMA = "conv_id long, turn long, role string, text string, conv string, d string, key string, part string"


def plain(rows, every=100, heads=6):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % heads
        start = own.get(c - (abs(c) % every) * (1 if c >= 0 else -1), [])
        path = tuple(start[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[x] for x in children[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def run(spark, rows, parts=4, **how):
    d = spark.createDataFrame([(*r, "a", "b", "c", "e") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in prefix_trie.conversation_trie(d, **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pool = [("user", "hello"), ("user", "héllo"), ("bot", "hello"), ("", "ab"), ("a", "b"), (None, "x"), ("user", None), ("user", "")]
    out = []
    for c in [*range(0, 130), 205, 206, 299, 1000, 1001, -3, -100, -105, 100_000_000_007]:
        for t in range(rng.randint(1, 9)):
            out.append((c, t, *(pool[rng.randrange(2)] if rng.random() < 0.7 else rng.choice(pool))))
    out += [(None, 0, "user", "no conversation")]
    out += [(300, None, "user", "first of all"), (300, None, "bot", "b"), (300, 2, "user", "twice"), (300, 2, "user", "twice"), (300, 2, "bot", "same turn")]
    out += [(400, t, "user", f"turn {t}") for t in range(600)] + [(401, t, "user", f"turn {t}") for t in range(600)]  # long, and alike but for the first
    for c in range(500, 600):
        out += [(c, t, "user", f"copied {t}") for t in range(7)]
    return out


@pytest.mark.parametrize("how", [{}, {"shard_rows": 30}, {"shard_rows": 1, "broadcast_rows": 0}, {"every": 7, "heads": 3, "shard_rows": 200}, {"heads": 1, "shard_rows": 50}])
def test_against_plain(spark, rows, how):
    said = {k: v for k, v in how.items() if k in ("every", "heads")}
    assert run(spark, rows, **how) == plain(rows, **said)


def test_conversation_in_many_parts(spark, monkeypatch, rows):
    """Paths longer than a block, ids longer than a chunk, and a conversation that lies in several tasks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert run(spark, rows, shard_rows=40) == plain(rows)
        hot = [(7, t, "user", "again") for t in range(900)] + [(c, 0, "user", "again") for c in range(1, 60)]
        assert run(spark, hot, shard_rows=40) == plain(hot)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_empty_and_turnless(spark):
    assert run(spark, []) == []
    lone = [(c, 0, "user", "x") for c in (5, 17, 31)]
    assert run(spark, lone) == plain(lone)


def test_louds():
    """Parents, degrees and sums of a random forest."""
    rng = np.random.default_rng(1)
    parent, depth = np.full(300, -1), np.zeros(300, np.int64)
    for i in range(5, 300):
        parent[i] = rng.integers(-1, i)
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    trie, order = Louds.of(parent, depth, np.arange(300))
    assert (trie.labels == order).all() and trie.bits().sum() == 300
    want = [parent[i] for i in order]
    assert [order[p] if p >= 0 else -1 for p in trie.parents()] == want
    assert trie.degrees().tolist() == [int((parent == i).sum()) for i in order]
    sums = np.ones(300, np.int64)
    for i in sorted(range(300), key=lambda i: -depth[i]):
        if parent[i] >= 0:
            sums[parent[i]] += sums[i]
    assert trie.rollup(np.ones(300))[0].tolist() == [sums[i] for i in order]
