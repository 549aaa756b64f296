"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partlake.llm import bpe, decontam, exact_dedup, html_extract, langid, ngram_join, secrets, sharding, suffix_dedup, token_records

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, row string, id string, key string, n long"


def docs_of(spark, texts, source=None, ids=None):
    rows = [
        (ids[i] if ids else i, t, ["en", "fr"][i % 2], source[i] if source else f"s{i % 3}", len(t or ""), "x", "y", "z", "k", 1) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    out = [None, "", "   \t\n", "one", "one two", "one two three", base[0], base[0], base[0].replace(" ", "  "), base[1].upper(), "é" * 300, "ab" * 400]
    out += base
    for b in base[:12]:
        w = b.split()
        if len(w) > 40:
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out.append(" ".join(prose(rng, 3000).split()))
    return out


# --- sharding ------------------------------------------------------------------------
def test_sharding_law_and_mixture(spark):
    rng = random.Random(1)
    source = [None if i % 50 == 0 else ("hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}") for i in range(1003)]
    d = docs_of(spark, ["t"] * 1003, source)
    rows = sharding.interleave_shards(d, 8).select("doc_id", "source", "shard", "slot", "n").collect()
    assert sorted(r.doc_id for r in rows) == list(range(1003))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for src, n in Counter(source).items():
        per = Counter(r.shard for r in rows if r.source == src)
        assert all(abs(per[s] - n / 8) <= 2 for s in range(8)), src
    again = sharding.interleave_shards(d.repartition(7), 8).select("doc_id", "shard", "slot").collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_sharding_equals_plain_sort(spark):
    d = docs_of(spark, ["t"] * 200)
    got = [r.doc_id for r in sharding.interleave_shards(d, 4).orderBy("shard", "slot").collect()]
    key = F.shiftrightunsigned(F.xxhash64(F.lit(20_011), "doc_id"), 1)
    rows = d.select("doc_id", "source", key.alias("k"), F.xxhash64(F.lit(20_011), F.concat(F.lit("1"), "source")).alias("t")).collect()
    placed = []
    for s in {r.source for r in rows}:
        mine = sorted((r for r in rows if r.source == s), key=lambda r: r.k)
        placed += [((2 * i + 1) / (2 * len(mine)), r.t, r.doc_id) for i, r in enumerate(mine)]
    assert got == [x[2] for x in sorted(placed)]


def test_sharding_small_tables(spark, tmp_path):
    assert sharding.interleave_shards(docs_of(spark, ["a"]).where("false"), 8).count() == 0
    few = sharding.interleave_shards(docs_of(spark, ["a", "b", "b"], ids=[1, 2, 2]), 8).collect()
    assert sorted((r.doc_id, r.slot) for r in few) == [(1, 0), (2, 0), (2, 0)] and len({r.shard for r in few}) == 3
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.interleave_shards(docs_of(spark, ["a"] * 50), 4), path, rows_per_file=5)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 4


# --- suffix arrays -------------------------------------------------------------------
def removed_by_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((len(b), sum(cover), runs, kept))
    return out


@pytest.mark.parametrize("length, gram", [(200, 96), (40, 12)])
def test_suffix_dedup(spark, mixed, length, gram):
    rng = random.Random(9)
    shared = prose(rng, 70)
    texts = mixed + [prose(rng, 30) + " " + shared + " " + prose(rng, rng.randint(0, 20)) for _ in range(6)] + ["a" * 900, shared[5:] + shared[:-9]]
    got = suffix_dedup.remove_repeats(docs_of(spark, texts), length, gram).collect()
    want = removed_by_force(texts, length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == dict(enumerate(want))


def test_suffix_dedup_long_text_and_shuffled_join(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1500)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    a = prose(rng, 900)
    texts = [a, a[1000:2500], prose(rng, 50), a[4000:]]
    bounds = [(h.n, rows.tolist()) for h, rows, _, _ in suffix_dedup._buffers(pa.RecordBatch.from_pydict({"t": texts}), 0, 200)]
    assert len(bounds) == 4 and max(n for n, rows in bounds if rows == [0]) == 1699  # the long text in stretches
    got = suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == dict(enumerate(removed_by_force(texts, 200)))


def test_suffix_dedup_repeated_rows_and_empty(spark):
    t = "x y z " * 60
    got = suffix_dedup.remove_repeats(docs_of(spark, [t, t, "short"], ids=[5, 5, 6])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(5, len(t)), (5, len(t)), (6, 0)]
    assert suffix_dedup.remove_repeats(docs_of(spark, [t]).where("false")).count() == 0


# --- secrets -------------------------------------------------------------------------
HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def field():
    rng = random.Random(2)
    with_secret = [f'{prose(rng, 20)} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {prose(rng, 10)}' for i in range(60)]
    return secrets.fit_field(with_secret + [prose(rng, 40) for _ in range(60)])


def test_base_spans():
    t = f'é API-key: x; Api_Key="abcdef" token=short1 passwd:  \'{HEX}\' AKIA{"A1" * 8} AKIAshort secretive'
    kinds = [(k, t[a:b]) for k, a, b in secrets.base_spans(t)]
    assert kinds == [("assign", 'Api_Key="abcdef'), ("assign", "token=short1"), ("assign", f"passwd:  '{HEX}"), ("hex", HEX), ("access", "AKIA" + "A1" * 8)]
    assert secrets.base_spans("ſecret = abcdefgh") == []


def test_secret_scan(spark, field):
    texts = [None, "", "plain words only", f"x {HEX} y", "call 4b825dc642cb6eb9a060e54bf8d69288fbee4904a1 now", "word " * 20_000 + HEX]
    rows = {r.doc_id: r for r in secrets.scan_secrets(docs_of(spark, texts), field).collect()}
    assert [len(rows[i].base) for i in range(6)] == [0, 0, 0, 1, 1, 1] and rows[5].base[0].start == 100_000
    assert all(set(map(tuple, rows[i].base)) <= set(map(tuple, rows[i].spans)) for i in rows)
    assert secrets.scan_secrets(docs_of(spark, ["a"]).where("false"), field).count() == 0
    assert secrets.redact("a XX b", [("field", 2, 4), ("hex", 2, 3)]) == "a [SECRET] b"


def test_viterbi_equals_brute_force(field):
    import itertools

    feats = [["bias", "shape=dl", "length=5"], ["bias", "shape=d"], ["bias", "hexadecimal"]]
    e = field.scores(feats)
    score = lambda tags: field.move[3, tags[0]] + sum(e[i, t] for i, t in enumerate(tags)) + sum(field.move[a, b] for a, b in zip(tags, tags[1:]))
    assert tuple(field.decode(feats)) == max(itertools.product(range(3), repeat=3), key=score)


def test_field_held_out(field):
    rng = random.Random(77)
    hits = [bool(secrets.field_spans(f"{prose(rng, 8)} {hashlib.sha1(str(-i).encode()).hexdigest()} {prose(rng, 8)}", field)) for i in range(40)]
    clean = [bool(secrets.field_spans(prose(rng, 60, ["The", "and", "of", "Thing,", "2024", "on."]), field)) for _ in range(40)]
    assert np.mean(hits) >= 0.9 and not any(clean)


def test_field_spans_outside_base_spans():
    text = "token = 123456789:AAHdqTcvCH1vGWJxfSeofSAs0K5PALDsaw and more"
    base = [("assign", 0, 17)]
    whole = ("field", 8, 51)
    assert secrets.outside(text, [whole], base) == [("field", 18, 51)]
    assert secrets.outside(text, [whole], []) == [whole]
    assert secrets.outside(text, [("field", 8, 17)], base) == []
    assert secrets.outside(text, [whole, ("field", 56, 60)], [("hex", 20, 25), ("hex", 30, 51)]) == [("field", 8, 20), ("field", 56, 60)]


# --- decontamination -----------------------------------------------------------------
def test_decontamination(spark, mixed):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (5, 9, 30, 33, 60)] + ["one two", "", None, prose(rng, 30)]
    docs = mixed + [prose(rng, 200) + " " + i.upper() + "\n" + prose(rng, 300) for i in items[:5]]
    cut = items[3].split()
    docs += [" ".join(cut[:28]), " ".join(cut[:20]), items[2] + " " + items[2]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontam.find_leaks(docs_of(spark, docs), bench).collect()}
    slow = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontam.find_leaks(docs_of(spark, docs), bench, broadcast_rows=0).collect()}

    def parts(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = {}
    for i, t in enumerate(items):
        for j, d in enumerate(docs):
            a, b = parts(t), parts(d)
            if a and 5 * len(a & b) >= 4 * len(a):
                want[j, i] = (len(a & b), len(a))
    assert got == want == slow and len(want) >= 7
    left = decontam.drop_leaks(docs_of(spark, docs), bench)
    assert left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id for r in left.collect()} == set(range(len(docs))) - {j for j, _ in want}
    none = bench.where("false")
    assert decontam.find_leaks(docs_of(spark, docs), none).count() == 0 and decontam.drop_leaks(docs_of(spark, docs), none).count() == len(docs)


# --- exact copies --------------------------------------------------------------------
def test_exact_dedup(spark, mixed):
    texts = mixed + ["hot text"] * 60 + ["hot  text", "hot\ttext "]
    strip = str.maketrans("", "", " \t\n\v\f\r")
    for counters in (4, 1024):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.group_copies(docs_of(spark, texts), counters=counters).collect()}
        groups = {}
        for i, t in enumerate(texts):
            groups.setdefault((t or "").translate(strip), []).append(i)
        want = {}
        for norm, ids in groups.items():
            keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
            for i in ids:
                want[i] = (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())
        assert got == want
    left = exact_dedup.drop_copies(docs_of(spark, texts))
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, w in want.items() if w[2]) and len(left.columns) == 10


def test_exact_dedup_repeated_ids(spark):
    d = docs_of(spark, ["a b", "a b", "ab", None], ids=[1, 1, 2, None])
    got = exact_dedup.group_copies(d).collect()
    assert sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {1, 3}
    assert sorted(str(r.doc_id) for r in exact_dedup.drop_copies(d).collect()) == ["1", "None"]
    assert exact_dedup.group_copies(d.where("false")).count() == 0


def test_misra_gries_keeps_heavy():
    rng = random.Random(0)
    mg = exact_dedup.MisraGries(5)
    xs = ["hot"] * 300 + ["warm"] * 250 + [f"x{i}" for i in range(600)]
    rng.shuffle(xs)
    for x in xs:
        mg.add(x)
    mg.shrink()
    assert len(mg.counts) <= 5 and {"hot", "warm"} <= set(mg.counts)


# --- byte-level BPE ------------------------------------------------------------------
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_round_trip(spark, mixed):
    texts = mixed + ["it's 12  \n\n x y \U0001f600 日本", "<|endoftext|>", " " * 50 + "\n" * 9]
    enc = bpe.load_encoding(RANKS, P.PATTERN)
    rows = bpe.decode_column(bpe.encode_column(docs_of(spark, texts), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(rows) == len(texts)
    at_once = bpe.round_trip_column(docs_of(spark, texts), RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in at_once) == sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    assert bpe.encode_column(docs_of(spark, ["a"]).where("false"), RANKS, P.PATTERN).count() == 0


def test_bpe_safe_boundaries():
    enc = bpe.load_encoding(RANKS, P.PATTERN)
    rng = random.Random(8)
    alphabet = ["a", "'s", "'", " ", "  ", "\n", "\t", "1", "é", "!", " ", "　", "ll"]
    for _ in range(60):
        t = "".join(rng.choice(alphabet) for _ in range(300))
        for size in (1, 7, 40):
            assert "".join(bpe.split_safely(t, size)) == t
            assert bpe.encode_text(enc, t, size).tolist() == enc.encode_ordinary(t)


@pytest.mark.parametrize("unit", [" ", "\n", " \n\t", "a", "!", "1", "a1!", "\u00e9", "\u65e5"])
def test_bpe_long_runs(spark, unit):
    """Runs without a safe boundary: short ones against the library, very long ones by round trip and by their regular ids."""
    enc = bpe.load_encoding(RANKS, P.PATTERN)
    for tail in ("", "x", " x", "\nx y"):
        t = "word " + unit * 3_000 + tail
        assert bpe.encode_text(enc, t, 64).tolist() == enc.encode_ordinary(t)
    n = 2_000_000 // len(unit)
    got = bpe.encode_text(enc, unit * n + "end")
    assert bpe.decode_ids(enc, got).decode() == unit * n + "end"
    # a match merges alike wherever it stands: the ids of the run repeat
    few = enc.encode_ordinary(unit * 4096)
    assert got[: len(few) // 2].tolist() == few[: len(few) // 2]


def test_bpe_long_run_in_spark(spark):
    rows = bpe.encode_column(spark.createDataFrame([(1, " " * 2_000_000), (2, "a b")], "doc_id long, text string"), RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id, len(r.ids) // 4) for r in rows)[1] == (2, 2) and len(rows) == 2


# --- HTML ----------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><div>Site name</div><nav><ul><li><a href="/x">Home</a></li></ul></nav></header>
<div id="cookie-notice">We use cookies on this site for many reasons.</div>
<main><article><h1>Title &amp; more</h1><p>First   para <i>x</i>.<p>Second<br>line &lt;b&gt; &eacute;</p><!-- ad --><ul><li>One<li>Two</ul>
<div class="advert">Buy now, great offer today only.</div><table><tr><td>a<td>b</table><form><label>Email</label><input></form>
<section class="comments"><h2>Comments</h2><p>Nice article, thanks a lot.</p></section></article>
<aside>Related stories that you may like</aside></main><footer>&copy; someone</footer></body></html>"""


def test_html_extraction(spark):
    w = html_extract.fit_weights([PAGE] * 3)
    assert html_extract.main_text(PAGE, w) == "Title & more\nFirst para x.\nSecond line <b> é\nOne\nTwo\na\nb"
    assert html_extract.main_text("<p>a<p>b", w) == "a\nb" and html_extract.main_text("", w) == ""
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", None), (2, None, ""), (3, "v", "<div><article><p>x <b>y"), (4, "w", "<<>&bad; text")], "page_id long, url string, html string")
    got = html_extract.extract_pages(pages).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id == 3} == {"x y"} and {r.text for r in got if r.page_id == 2} == {""}
    assert html_extract.extract_pages(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=x><body><article><p>Kept one.<p>Kept two.</article></body></html>",
        "<head><title>T</title><link rel=x href=y><article><p>Kept one.<p>Kept two.</article>",
        "<head><title>T</title>Kept one.<p>Kept two.",
        "<html><head><script>for (i = 0; i<n ; i++) {} // don't</script></head><body><p>Kept one.<p>Kept two.</p><p hidden='x'></p></body></html>",
        "<body><script>if (a<b) x = 'it</script><p>Kept one.<p title='t'>Kept two.</body>",
        "<head><style>a<b 'c{}</style></head><p>Kept one.<p title='x'>Kept two.",
        "<div><form><input><label>Mail</label></div><p>Kept one.<p>Kept two.",
        "<div><form><div><script>a<b 'c</script><label>Mail</label></div></div><p>Kept one.</p><div title='x'><p>Kept two.</p><form>x</form></div>",
        "<div><div><select><option>A<option>B</div><p>Kept one.</p><select><option>C</select><p>Kept two.</p></div>",
        "<p>Kept one.<button>Press</p><p>Kept two.</p><button>x</button>",
        "<p>Kept one.<svg><path d='x'><text>Drawn</text><p>Kept two.</p><svg><path/><title/></svg>",
        "<p>Kept one.<svg><foreignObject><div>Drawn</div></foreignObject><style/><g/></svg><p>Kept two.",
        "<div><form><div><form></form></div></div><p>Kept one.<p>Kept two.",
        "<body><noscript><img src=x><p>Kept one.<p>Kept two.",
        "<p>Kept one.<button>a<button>b</button><p>Kept two.",
    ],
)
def test_html_broken_silent_elements(page):
    assert [b.text for b in html_extract.page_blocks(page)] == ["Kept one.", "Kept two."]


ART = "".join(f"<p>Paragraph number {i} of the story, with a few words more.</p>" for i in range(4))
ART_TEXT = [f"Paragraph number {i} of the story, with a few words more." for i in range(4)]


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form id=f method=post><div class='header'><a href=/>Home</a></div><div class='content'>{ART}</div><div id=footer>Copyright x</div></form></body>", ART_TEXT),
        (f"<body><form><article><h1>T</h1>{ART}</article></form>", ["T", *ART_TEXT]),
        ("<body><form><input>Mail<article><p>Kept one.<p>Kept two.</article></body>", ["Kept one.", "Kept two."]),
        ("<body><form><label>User</label><input><label>Password</label><p>Forgot?</p></form>", []),
        (f"<article>{ART}<form><p>Get our letters, every week.</p><input></form></article>", ART_TEXT),
        ("<article><p>One two three.</p><button>Share<p>Four five.</p><div>Six seven.</div></article><button>x</button>", ["One two three.", "Four five.", "Six seven."]),
        ("<article><p>One two three.</p><form><input><form><input></form><p>Four five.</p></article>", ["One two three.", "Four five."]),
        ("<article><p>One two three.</p><a onclick=it's>link</a><p>Four five, it's.</p></article>", ["One two three.", "link", "Four five, it's."]),
        (f"<article><div class='social-content'>{ART}</div><section id='search-history'><p>Others, too.</p></section></article>", [*ART_TEXT, "Others, too."]),
        (f"<article>{ART}<div class=comments><p>Nice article, thanks a lot.</p></div><div class='share-buttons'><a>Share</a></div></article>", ART_TEXT),
        (f"<main><div class='related-links'><a href=x>Other story about things.</a></div><div class=post>{ART}</div></main><div class='cookie-content'>We use cookies.</div>", ART_TEXT),
    ],
)
def test_html_forms_names_quotes(page, want):
    assert html_extract.main_text(page, html_extract.fit_weights([])).split("\n") == (want or [""])


def test_html_large_and_deep_pages():
    """Work grows with the page: many blocks and deep nesting take seconds, not hours."""
    import time

    began = time.perf_counter()
    w = html_extract.fit_weights([])
    many = "<main>" + "".join(f"<div><p>Block {i} of the text.</p></div>" if i % 3 else f"<li><a href=x>link {i}</a>" for i in range(20_000))
    assert html_extract.main_text(many, w).count("of the text.") == sum(1 for i in range(20_000) if i % 3)
    deep = "<div>" * 10_000 + "<p>x y.</p>" + "</div><p>z</p>" * 10_000
    assert len(html_extract.page_blocks(deep)) == 10_001
    assert time.perf_counter() - began < 30


def test_html_cut_of_nested_sections_needs_no_search(monkeypatch):
    rng = random.Random(1)
    page = "".join(rng.choice(["<div>", "</div>", "<p>a b c.", "<ul><li>x", "</ul>", "<section><p>t"]) for _ in range(3_000))
    blocks = html_extract.page_blocks(page)
    edges = html_extract.smoothness_edges(blocks, 0.5)
    a, b = [rng.random() for _ in blocks], [rng.random() for _ in blocks]
    cost = lambda x: sum(b[i] if x[i] else a[i] for i in range(len(a))) + sum(w for i, j, w in edges if x[i] != x[j])
    by_flow = cost(html_extract._max_flow(a, b, edges))
    monkeypatch.setattr(html_extract, "_max_flow", None)
    assert len(blocks) > 1000 and abs(cost(html_extract.minimum_cut(a, b, edges)) - by_flow) < 1e-6


def test_html_whole_pages(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_extract.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<br>|</?b>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_minimum_cut_equals_brute_force():
    import itertools

    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(1, 7)
        a, b = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        e = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda x: sum(b[i] if x[i] else a[i] for i in range(n)) + sum(w for i, j, w in e if x[i] != x[j])
        assert abs(cost(html_extract.minimum_cut(a, b, e)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6


# --- n-gram join ---------------------------------------------------------------------
def components_by_force(texts, k, num, den):
    sets = []
    for t in texts:
        w = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("k, num, den, cells", [(4, 85, 100, 2_000_000), (5, 4, 5, 300)])
def test_ngram_join(spark, mixed, k, num, den, cells):
    rng = random.Random(12)
    base = prose(rng, 150).split()
    near = []
    for _ in range(60):  # one group of near copies, many of them beyond the threshold of each other
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        near.append(" ".join(w))
    common = " ".join(base[:50])
    texts = mixed + near + [common + " " + prose(rng, 60) for _ in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs_of(spark, texts), k, num, den, block_cells=cells).collect()}
    assert got == components_by_force(texts, k, num, den)


def test_ngram_join_many_chunks_and_blocks(spark, monkeypatch):
    """Columns with many rows that do not link are compared chunk by chunk, and rows are cut into many blocks."""
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    monkeypatch.setattr(ngram_join, "ROW_CELLS", 10)
    rng = random.Random(5)
    base = prose(rng, 120).split()
    pool = [[f"v{i}x{j}" for j in range(4)] for i in range(30)]
    texts = []
    for _ in range(90):  # one template with slots: few pairs link, all share most columns
        w = list(base)
        for i in rng.sample(range(30), rng.randint(1, 9)):
            w[4 * i] = rng.choice(pool[i])
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs_of(spark, texts), 4, 85, 100, block_cells=400).collect()}
    assert got == components_by_force(texts, 4, 85, 100)


def test_ngram_join_sums_partial_overlaps(spark):
    rows = [(1, 6, 0, [1, 3, 5]), (1, 6, 1, [2, 4]), (2, 6, 0, [3, 5, 7]), (2, 6, 1, [2, 4]), (3, 6, 1, [2])]
    alive = spark.createDataFrame(rows, "key long, n long, part int, cols array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert sorted(map(tuple, ngram_join._products(pairs, alive, 1, 2).collect())) == [(1, 2, 4, True), (1, 3, 1, False)]


def test_ngram_join_small(spark):
    d = docs_of(spark, ["a b", "A  b", "b a", None, " "], ids=[7, 7, 8, 9, None])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.class_size) for r in ngram_join.jaccard_components(d).collect())
    assert got == [("7", 1, "7", 2), ("7", 1, "7", 2), ("8", 1, "8", 1), ("9", 0, "9", 1), ("None", 0, "None", 1)]
    assert ngram_join.jaccard_components(d.where("false")).count() == 0


# --- token records -------------------------------------------------------------------
def crc32c_bitwise(data):
    r = 0xFFFFFFFF
    for b in data:
        r ^= b
        for _ in range(8):
            r = (r >> 1) ^ (0x82F63B78 if r & 1 else 0)
    return r ^ 0xFFFFFFFF


def test_crc32c():
    rng = random.Random(1)
    assert token_records.crc32c(b"123456789") == 0xE3069283
    items = [rng.randbytes(n) for n in (0, 1, 8, 255, 256, 257, 1000, 4097)]
    assert token_records.crc32c_many(items).tolist() == [crc32c_bitwise(x) for x in items]
    framed = token_records.frames(items)
    assert token_records.unframe(framed) == items
    for at in (0, 9, 13, len(framed[-1]) - 1):
        bad = bytearray(framed[-1])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe([bytes(bad)])


def test_token_records(spark, mixed, tmp_path):
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    tok.encode_special_tokens = True
    texts = mixed + ["It's <|endoftext|> ÀÉ ße ŒÅ İx áb c don't, end. 日本 ٣", "x." * 3000]
    path = f"file://{tmp_path}/records"
    index = token_records.write_token_records(docs_of(spark, texts), path, file, partitions=3)
    assert index.count() == len(texts)
    rows = sorted(token_records.read_token_records(spark, path).collect(), key=lambda r: (r.part, r.row))
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r in rows:
        want = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want
    empty = f"file://{tmp_path}/none"
    assert token_records.write_token_records(docs_of(spark, ["a"]).where("false"), empty, file).count() == 0


# --- languages -----------------------------------------------------------------------
def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = langid.predict_languages(d, langid.learn_profiles(d.where(~langid.held_out())))
    test = said.join(d.select("doc_id", "lang"), "doc_id").where(langid.held_out()).collect()
    assert np.mean([r.lang_pred == r.lang for r in test]) >= 0.97 and all(0 <= r.score <= 1 for r in test)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5) == 0 for r in test)


def test_language_edges(spark):
    d = docs_of(spark, [None, "", "123 !?", "the cat sat on the mat " * 5, "ÉÀ le chat est sur la table " * 5, "the " * 50_000])
    known = langid.learn_profiles(d)
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(d, known).collect()}
    assert [rows[i] for i in range(3)] == [("und", 0.0)] * 3 and rows[3][0] == "fr" and rows[4][0] == "en"
    assert {r.lang_pred for r in langid.predict_languages(d, known.where("false")).collect()} == {"und"}
    assert langid.learn_profiles(d.where("false")).count() == 0


def test_language_counts_by_force():
    text = "Ab, ab c"
    codes, counts = langid.ngram_counts(text)
    def unpack(c):
        out = []
        while c:
            out.append(chr(c & 0x1FFFFF))
            c >>= 21
        return "".join(reversed(out))
    got = dict(zip(map(unpack, codes.tolist()), counts.tolist()))
    padded = " ab ab c "
    want = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                want[g] += 1
    assert got == dict(want)


def test_words_of_a_known_form_do_not_link(spark):
    """The Thue-Morse word and its complement collide under any polynomial hash modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    docs = spark.createDataFrame([(i, f"{w[:n]} x y z") for i, (w, n) in enumerate((w, n) for n in (1024, 2048, 4096) for w in (a, b))], "doc_id long, text string")
    rows = ngram_join.jaccard_components(docs, k=4, num=85, den=100).collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in rows) == [(i, i, 1) for i in range(6)]
