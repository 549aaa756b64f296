"""The field on secrets of kinds that the base patterns do not know, and the base patterns by force."""

import base64
import hashlib
import json
import random
import string

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from partlake.llm import secrets

ALNUM = string.ascii_letters + string.digits
TABLE = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def texts():
    return [t for t in pq.read_table(TABLE).column("text").to_pylist() if t]


@pytest.fixture(scope="module")
def field(texts):
    return secrets.fit_field([t[:20_000] for t in texts[::2]])


def kinds(rng):
    of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=").decode()

    def password():
        while True:
            w = of(ALNUM + "!$%*#@", 12)
            if any(c.isdigit() for c in w) and any(c.isupper() for c in w) and any(c.islower() for c in w):
                return w

    return {
        "web token": lambda: ".".join(
            [b64(json.dumps({"alg": "HS256"}).encode()), b64(json.dumps({"sub": of(ALNUM, 10)}).encode()), b64(hashlib.sha256(of(ALNUM, 9).encode()).digest())]
        ),
        "slack": lambda: f"xoxb-{rng.randrange(10**11, 10**12)}-{rng.randrange(10**11, 10**12)}-{of(ALNUM, 24)}",
        "github": lambda: "ghp_" + of(ALNUM, 36),
        "google": lambda: "AIza" + of(ALNUM + "-_", 35),
        "stripe": lambda: "sk_live_" + of(ALNUM, 24),
        "base62": lambda: of(ALNUM, 32),
        "base64": lambda: base64.b64encode(rng.randbytes(30)).decode(),
        "upper hex": lambda: rng.randbytes(20).hex().upper(),
        "password": password,
    }


@pytest.mark.parametrize("form", ["%s", "credential: %s", "Authorization: Bearer %s", "(%s)"])
def test_recall_of_planted_secrets(texts, field, form):
    rng = random.Random(form)
    for kind, make in kinds(rng).items():
        hits = 0
        for _ in range(40):
            text = rng.choice([t for t in texts[1::2] if len(t) > 200])
            at, secret = text.find(" ", rng.randrange(100)) + 1, make()
            start = at + form.index("%s")
            spans = secrets.find_secrets(text[:at] + form % secret + " " + text[at:], field)[1]
            covered = {i for _, a, b in spans for i in range(max(a, start), min(b, start + len(secret)))}
            hits += len(covered) >= 0.9 * len(secret)
        assert hits >= 36, kind


def test_clean_texts_stay(texts, field):
    held_out = texts[1::2]
    assert sum(bool(secrets.field_spans(t, field)) for t in held_out if not secrets.base_spans(t)) == 0
    plain = """Read https://docs.example.org/guide/chapter-12/index.html#install and https://github.com/some-user/some-repo/pull/1234 first.
    Release v2.13.4-rc1 of parquet-tools_0.9.tar.gz came on 2024-05-17T08:30:00Z; mail jane.doe42@mail.example.com or call +44-020-7946-0958.
    The method getUserNameById and the constant MAX_RETRY_COUNT are in src/main/java/ServiceFactory2.java, commit 4b825dc.
    Donaudampfschifffahrtsgesellschaftskapitaen, ISBN 978-3-16-148410-0, part D38999/26WB35SN, row 12345678901234567890.
    See lib/python3.11/site-packages/ArrayView.py, com.example.BillingServiceImpl.handleRequest2(), application/vnd.ms-excel12 and the XMLHttpRequest2Level.
    H2SO4-C6H12O6 at 12:30:45.123 in Building_7B/Room-114a; 550e8400-e29b-41d4-a716-446655440000 is an identifier of 36 signs, 10.0.0.12:8080 an address."""
    assert secrets.field_spans(plain, field) == []


def by_force(text):
    """Base spans by trying every place."""
    out = []

    def scan(kind, match):
        i = 0
        while i < len(text):
            end = match(i)
            if end is None:
                i += 1
            else:
                if end[1]:
                    out.append((kind, i, end[0]))
                i = end[0]

    def span(i, chars):
        while i < len(text) and text[i] in chars:
            i += 1
        return i

    def assign(i):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i : i + 8])
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word):
                j = i + len(word)
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                j = span(j, " ")
                if text[j : j + 1] not in (":", "=") or j >= len(text):
                    return None
                j = span(j + 1, " ")
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                end = span(j, ALNUM + "+/_.=-")
                return (end, end - j >= 6) if end > j else None
        return None

    def access(i):
        end = span(i + 4, string.ascii_uppercase + string.digits)
        return (end, end - i >= 20) if text.startswith("AKIA", i) and end > i + 4 else None

    def hexa(i):
        end = span(i, "0123456789abcdef")
        return (end, end - i >= 24) if end > i else None

    scan("assign", assign), scan("access", access), scan("hex", hexa)
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_base_spans_by_force(texts):
    rng = random.Random(4)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "APIkey", "'", '"', " ", "  ", ":", "=", "==", "abc", "abcdef", "x.y-z/", "AKIA", "A1" * 9, "0a" * 12, "f" * 23, "é", "\n", "ſecret"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for t in made + texts[:300]:
        assert secrets.base_spans(t) == by_force(t)


def test_table_edges(spark, field):
    """Null ids and texts, repeated rows, one very long run, and columns named like the results."""
    rows = [(None, "a1.B2-" * 30_000, "x"), (1, None, "x"), (2, "", "x"), (3, "ghp_" + "aB3dE6gH9" * 4, "x"), (3, "ghp_" + "aB3dE6gH9" * 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("base", F.lit(1))
    got = secrets.scan_secrets(df, field)
    assert got.columns == ["doc_id", "base", "spans"]
    out = [(r.doc_id, [tuple(s) for s in r.spans]) for r in got.collect()]
    assert len(out) == 5 and (1, []) in out and (2, []) in out and out.count((3, [("field", 0, 40)])) == 2
