"""Line dedup against a plain version, with nulls, ties, repeats, long texts and clashing names."""

import random
from collections import defaultdict

import pytest

from partlake.llm import line_dedup

SCHEMA = "doc_id long, text string, id string, row string, pos string, digest string, first string, gone string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def plain(docs, min_chars=10, min_docs=2):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    first = {k: min(v, key=lambda x: (x is None, x or 0)) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in first or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def run(spark, docs, **how):
    d = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in docs], SCHEMA).repartition(3)
    return [tuple(r) for r in line_dedup.drop_repeated_lines(d, **how).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    pool = ["a line of some length", "A LINE of some length ", "\tÀ propos de rien", "à propos de rien", "short", "ninechars", "ten chars.", "", "   ", "Straße ΑΣ ΟΣ", "straße ας ος", "İstanbul is a city", " wide blank here", "a b c d e f", "x\ry z w v u t s", "ⅠⅡ Ⓐ roman numerals"]
    out = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {rng.random()}" for _ in range(rng.randint(1, 12)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, "\n"), (103, "\n\n a line of some length"), (None, "a line of some length\nnull one"), (None, "only without an id, twice"), (None, "only without an id, twice")]
    out += [(104, "same row, same id here"), (104, "same row, same id here"), (104, "another row of it\nsame row, same id here")]
    out += [(105, "\n".join(f"line number {i % 700}" for i in range(20000))), (106, "line number 3\n" * 500), (-7, "ten chars.\nten chars.")]
    return out


@pytest.mark.parametrize("how", [{}, {"broadcast_lines": 0}, {"min_docs": 4}, {"min_chars": 0}])
def test_against_plain(spark, docs, how):
    asked = {k: v for k, v in how.items() if k != "broadcast_lines"}
    assert ordered(run(spark, docs, **how)) == ordered(plain(docs, **asked))


def test_hot_line(spark):
    docs = [(i, f"one line that all documents share\nown {i} text") for i in range(3000)]
    rows = run(spark, docs, broadcast_lines=0)
    assert sum(r[2] for r in rows) == 2999
    assert next(r for r in rows if r[0] == 0)[3] == docs[0][1]


def test_empty_table(spark):
    assert run(spark, []) == []
