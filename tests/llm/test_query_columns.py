"""Columns that the thin queries derive, against plain Python over a whole small table."""

import hashlib
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from partlake.llm import queries, secrets

SF = "/root/testdata/sf0.001"
SIZE = 300


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def grams(text):
    """N-grams of one to three signs of the padded words; none over two words."""
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    out = Counter()
    for w in words:
        padded = f" {w} "
        out.update(g for n in (1, 2, 3) for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " ")
    return out


def profile(counts):
    def code(g):
        n = 0
        for c in g:
            n = n << 21 | ord(c)
        return n

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:SIZE]


def test_language_predictions_by_force(spark, docs):
    held = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0
    known = {}
    for d in docs:
        if not held(d) and d["lang"] is not None:
            known.setdefault(d["lang"], Counter()).update(grams(d["text"]))
    places = {lang: {g: i for i, g in enumerate(profile(c))} for lang, c in known.items() if c}
    rows = {r.doc_id: r for r in queries.QUERIES["op10_language_id"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        top, r = profile(grams(d["text"])), rows[d["doc_id"]]
        assert r.held_out == held(d)
        if not top:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {lang: sum(min(SIZE, abs(p.get(g, 10**6) - i)) for i, g in enumerate(top)) for lang, p in places.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and abs(r.score - (1 - far[best] / (SIZE * len(top)))) < 1e-12


def test_sharding_columns(spark, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op1_sharding"](spark, SF).collect()}
    for d in docs:
        raw, r = (d["text"] or "").encode(), rows[d["doc_id"]]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_secret_columns(spark, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_secret_scan"](spark, SF).collect()}
    for d in docs:
        base, r = secrets.base_spans(d["text"] or ""), rows[d["doc_id"]]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in base) for k in ("assign", "access", "hex"))
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
