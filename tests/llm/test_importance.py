"""Importance resampling against a plain version, with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from partlake.llm import importance

SCHEMA = "doc_id long, text string, id string, rank string, score string, part string, at string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=10, min_words=20, longest=1, buckets=10_000, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, fs = features(text, longest)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = Counter((r[0], *r[2:], k + 1) for k, r in enumerate(able[: percent * len(able) // 100]))
    taken = Counter((k[0], k[1], k[2], k[3]) for k in drawn.elements())
    rest = Counter((r[0], *r[2:]) for r in rows) - taken
    return drawn + Counter({(*k, None): n for k, n in rest.items()})


def run(spark, docs, target, parts=5, **how):
    d = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in docs], SCHEMA).repartition(parts)
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(target)], "item_id string, text string")
    return Counter(tuple(r) for r in importance.resample(d, t, **how).collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "naïve", "x-y", "a_b", "日本", "don't", "A1b2"]
    out = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 90)))) for i in range(200)]
    out += [(300, None), (301, ""), (302, "..."), (303, "one"), (None, " ".join(pool[:40])), (None, " ".join(pool[:40])), (304, out[5][1] + " w1" * 30), (304, out[5][1] + " w1" * 30)]
    return out + [(305, " ".join(rng.choice(pool) for _ in range(60000))), (306, "é" * 400_000 + " b")]


TARGET = ["w1 w2 w3 w1", None, "", "Été w7 w8 w9 naïve"] * 3


@pytest.mark.parametrize("how", [{}, {"longest": 3}, {"percent": 100, "min_words": 0, "buckets": 64, "seed": 1}, {"percent": 0}])
def test_against_plain(spark, monkeypatch, docs, how):
    assert run(spark, docs, TARGET, **how) == plain(docs, TARGET, **how)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_pieces_and_full_tries(monkeypatch, longest):
    """Cut texts and tries that start anew give the same buckets."""
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(400))
    want = Counter(zlib.crc32(f.encode()) % 97 for f in features(text, longest)[1])
    monkeypatch.setattr(importance, "PIECE", 37)
    totals, trie = importance.np.zeros(97, "int64"), importance.Trie()
    for words, met in importance.word_pieces(text.encode(), longest):
        for nodes in trie.paths(words, longest, met):
            for node in nodes:
                node.count += 1
        if len(trie.nodes) > 20:
            trie.add_to(totals)
    trie.add_to(totals)
    assert {b: n for b, n in enumerate(totals) if n} == want


def test_empty_tables(spark, docs):
    assert run(spark, [], TARGET) == Counter()
    assert run(spark, docs, []) == plain(docs, [])


def test_drawn_documents(spark, docs):
    d = spark.createDataFrame([(i, t) for i, t in docs if i is not None and i < 300], "doc_id long, text string")
    drawn = importance.resample(d, spark.createDataFrame([(t,) for t in TARGET], "text string"))
    ids = {r.doc_id for r in drawn.where("rank is not null").collect()}
    assert {r.doc_id for r in importance.drawn_documents(d, drawn).collect()} == ids and ids
