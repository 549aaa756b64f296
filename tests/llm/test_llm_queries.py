import hashlib
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import SF, compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from partlake.llm import bpe  # noqa: E402
from partlake.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_whole_table(spark, name):
    table = "pages" if name == "op7_html_extraction" else "documents"
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_token_positions(spark):
    rows = sorted(QUERIES["op9_token_records"](spark, SF).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_pipeline(spark):
    """Stage decisions by plain Python over the small table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()

    def parts(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    texts = {i: t for i, t in zip(docs.doc_id, docs.text) if t and any(c.isalpha() for c in t)}
    best = {}
    for i, t in texts.items():
        norm = "".join(t.split())
        if norm not in best or (-len(t), i) < (-len(texts[best[norm]]), best[norm]):
            best[norm] = i
    left = sorted(best.values())
    sets = {i: parts(texts[i]) for i in left}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if b < a:
                o = len(sets[a] & sets[b])
                if o and 5 * o >= 4 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    left = [i for i in left if find(i) == i]
    bench = [parts(t) for t in items.text]
    left = [i for i in left if not any(5 * len(b & sets[i]) >= 4 * len(b) for b in bench if b)]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == left
    enc = bpe.load_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert len(rows) > 0 and Counter(type(r.n_tokens) for r in rows)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_language_stage_without_labels(spark):
    """Only texts without a letter go where no profile can be learned, or where ``und`` is a label."""
    texts = ["the cat", "123 !?", None, "", "\u65e5\u672c"]
    for lang in (None, "und"):
        docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [0, 4]
    # labelled rows hold no letter
    docs = spark.createDataFrame([(0, "1 2", "en", "s", 3), (1, "the cat", None, "s", 7)], docs.schema)
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()] == [1]


def test_added_tokens_in_texts(spark, tmp_path):
    """Ids of the tokenizer as it is loaded, for literals of its added tokens."""
    import zlib

    from tokenizers import Tokenizer

    a, b = "<|startoftext|>", "<|endoftext|>"
    texts = [f"one {a} two {b}", f"o{a}ne tw{b}o,{b}", f"{b}{b}{a}", b.upper(), f"  {b} x.{a}\t\u00c9t\u00e9{b}don't", "<|end oftext|>", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = sorted(QUERIES["op9_token_records"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, t in zip(rows, texts, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    """Rows go by id and text: clean rows stay beside a near copy or a leak under their id, and one row of a component stays."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    item = " ".join(f"q{i}" for i in range(12))

    def table(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def left(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    rows = [(1, a), (None, a + " x"), (None, b), (None, None), (None, None), (5, c + " x"), (5, c), (5, d), (7, a + " y"), (7, "other words that stay"), (8, " "), (8, " "), (9, "twice"), (9, "twice")]
    got = left(corpus_pipeline.near_copies(spark, table(rows), SF))
    kept = [r for r in got if r[0] == 5 and r[1] != d]
    assert len(kept) == 1 and kept[0] in rows
    assert [r for r in got if r not in kept] == sorted([(1, a), (None, b), (None, None), (None, None), (5, d), (7, "other words that stay"), (8, " "), (8, " "), (9, "twice")], key=str)

    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a), (None, "x " + item), (None, None), (3, b), (3, item + " y"), (4, c)]
    want = sorted([(None, a), (None, None), (3, b), (4, c)], key=str)
    assert left(corpus_pipeline.benchmark_leaks(spark, table(rows), str(tmp_path))) == want
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert left(corpus_pipeline.benchmark_leaks(spark, table(rows), f"{tmp_path}/none")) == sorted(rows, key=str)


def test_stages_with_clashing_columns_and_empty_tables(spark):
    """Columns named like the stages' own pass through; an empty table stays empty."""
    rows = [(i, t, "en", "s", len(t or ""), f"k{i}", f"r{i}", "x") for i, t in enumerate(["the cat sat on the mat", "the cat  sat on the mat", None, "", "12", "a b c d e f"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __key string, __row string, __RN string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert all((r["__key"], r["__row"], r["__RN"]) == (f"k{r.doc_id}", f"r{r.doc_id}", "x") for r in got.collect()), name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
