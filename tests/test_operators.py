import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from partlake.functions import text as X
from partlake.operators import convert, corpus, decode, dispatch, drawing, electrical, environment, geometry, quality, validate, windows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()[0]


def parse(spark, *pns):
    return decode.parse_strict(spark.createDataFrame([(p,) for p in pns], "raw_pn string"))


def test_parse_golden(spark):
    r = parse(spark, "D38999/43 N B - 35 P N").first()
    assert (r.normalized, r.series, r.size_number, r.key) == ("D38999/43NB35PN", "IV", "11", "N")
    r = parse(spark, "d38999/26AAD35P").first()
    assert (r["class"], r.normalized, r.size_padded) == ("AA", "D38999/26AAD35PN", "15")
    assert parse(spark, "D38999/26WA35PN").first().size_padded == "09"


def test_parse_errors(spark):
    got = {r.raw_pn: r.error for r in parse(spark, "XYZ", "D38999/28WA35PN", "D38999/26QA35PN", "D38999/26WD35PN", None).collect()}
    assert got == {"XYZ": "not a pin", "D38999/28WA35PN": "unsupported sheet", "D38999/26QA35PN": "class not parsed", "D38999/26WD35PN": None, None: "not a pin"}


def test_forward_golden(spark):
    rows = convert.convert_forward(parse(spark, "D38999/26WD35PN", "D38999/43NB35PN")).collect()
    got = {(r.normalized, r.vendor_pn) for r in rows}
    want = ["TV06RW-15-35PN", "AE326WD35PN", "233-105-G6NF15-35PN", "KJA6T15W35PN", "8D5-15W35PN", "DTS26W1535PN"]
    assert {p for n, p in got if n == "D38999/26WD35PN"} == set(want)
    assert {p for n, p in got if n == "D38999/43NB35PN"} == {"AE443NB35PN", "BLH7N11-35PN", "234-100-H7ZL11-35PN"}


@pytest.mark.parametrize(
    "number, pin",
    [("TV07WCI2111PF459", "D38999/24WG11PN"), ("TVP00WGQLI17-35P-LC", "D38999/20WE35PN"), ("TV06RW-9-135QZ", "D38999/26WA135QZ"), ("DTS20Y1135PN", "D38999/21YB35PN"), ("KJA6T15W35PN", "D38999/26WD35PN"), ("8d5-15w35pn", "D38999/26WD35PN"), ("AE326WD35PN-LC", "D38999/26WD35PN")],
)
def test_reverse_golden(spark, number, pin):
    got = {r.normalized for r in convert.convert_reverse(spark.createDataFrame([(number,)], "vendor_pn string")).collect()}
    assert pin is None or pin in got


def test_grammars(spark):
    pns = ["D38999/26WA35PN", "D38999/31WA10PN5", "D38999/22A1W", "D38999/32W11N", "D38999/26-WA35PN"]
    rows = decode.decode_grammars(spark.createDataFrame([(p,) for p in pns], "raw_pn string")).collect()
    assert [(r.grammar, r.size) for r in rows] == [("standard", "A"), ("lanyard", "J"), ("dummy", "A1"), ("cover", "B"), (None, None)]
    assert [r.valid for r in rows] == [True, True, False, True, False]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (X.compact, " d38999/ 26-w ", "D38999/26W"),
        (X.normal_key, "d-1 / x!", "D1/X"),
        (X.complete_shorthand, "26WA35PN", "D38999/26WA35PN"),
        (X.complete_shorthand, "/26WA35PN", "D38999/26WA35PN"),
        (X.strip_order_suffixes, "TV06F459LF", "TV06"),
        (X.strip_order_suffixes, "TV06-LC", "TV06"),
        (X.drop_crimp_mark, "TVP00RW", "TVP00W"),
        (X.strip_tags, "<b>a</b>&amp;<i>b</i>", "a & b"),
        (X.escape_csv, 'a"b', '"a""b"'),
        (X.natural_key, "A10b2", "a000000000010b000000000002"),
        (X.display_key, " Box_Mount - X ", "box mount-x"),
        (X.snake_case, "camelCaseHTML", "camel_case_html"),
        (X.humanize, "emi_straight-plug", "EMI Straight Plug"),
        (X.ensure_sentence, "a b", "a b."),
        (X.first_sentence, "One. Two.", "One."),
        (X.safe_filename, "a b/c", "a_b_c"),
        (X.escape_html, "<a>", "&lt;a&gt;"),
        (X.token, "RJ-45 f", "rj45f"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_summary_and_lists(spark):
    assert one(spark, "a  b" * 50, lambda c: X.summarize(c, 20)).endswith("...")
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>").select(X.readable_list("x")).collect()
    assert [r[0] for r in rows] == ["", "a", "a and b", "a, b, and c"]


def test_derating_golden(spark):
    df = spark.createDataFrame([(n,) for n in (1, 4, 10, 75, 101)], "n int").select(electrical.derating(F.col("n")))
    assert [round(r[0], 6) for r in df.collect()] == [1.0, 0.815, 0.70, 0.485, 0.45]


def test_mates(spark):
    edges = {(r.sheet, r.mate) for r in validate.mate_edges(spark).collect()}
    assert {m for s, m in edges if s == "26"} == {"20", "24"} and ("40", "46") in edges
    r = validate.mates(parse(spark, "D38999/26WD35PN")).orderBy("mate").first()
    assert (r.mate_pn, r.fails) == ("D38999/20WD35SN", [])


def test_environment_invariant(spark):
    d = decode.decode_grammars(spark.createDataFrame([("D38999/26WD35PN",), ("D38999/32W11N",), ("D38999/21YB35PN",)], "raw_pn string"))
    best = environment.best_profiles(environment.profiles(d), "raw_pn")
    tags = {r.raw_pn: set(r.tags.split(",")) for r in environment.tags(best, "raw_pn").collect()}
    assert "D38999/32W11N" not in tags and "vacuum" in tags["D38999/21YB35PN"] and "salt_fog" in tags["D38999/26WD35PN"]
    for r in best.collect():
        assert (r.environment in tags.get(r.raw_pn, set())) == (r.score >= 3)


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (3, 3), (3, 5), (5, 6)]:
        cost = rng.random((n, m))
        to = geometry.min_cost_assignment(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(to)) == n and abs(sum(cost[i, j] for i, j in enumerate(to)) - best) < 1e-9


def test_chunks_and_diff(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 5, 6, 20, 1])], "p string, o long, s long")
    got = [r.chunk for r in windows.chunks_by_size(df, "p", "o", F.col("s"), 10).orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 3]
    old, new = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2], [2, 3, 3]))
    assert {r.k: r.change for r in corpus.snapshot_diff(old, new, "k").collect()} == {1: "removed", 2: "kept", 3: "added"}


def chunks_by_force(rows, limit):
    out, used, no = [], {}, {}
    for p, o, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2] or 0)):
        s = s or 0
        if used.get(p, 0) > 0 and used[p] + s > limit:
            no[p], used[p] = no[p] + 1, s
        else:
            no[p], used[p] = no.get(p, 0), used.get(p, 0) + s
        out.append((p, o, no[p]))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit, high", [(10, 4), (50, 12), (3, 9), (10_000, 5)])
def test_chunks_over_ranges(spark, monkeypatch, limit, high):
    import random

    monkeypatch.setattr(windows, "RANGE_ROWS", 40)
    rng = random.Random(limit)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i if rng.random() < 0.8 else 7, rng.choice([None, 0, rng.randint(0, high), 1])) for i in range(900)]
    rows += [("zeros", i, 0) for i in range(90)] + [("zeros", 90, 60), ("zeros", 91, 0), ("zeros", 92, 60), ("null order", None, 5), ("null order", None, 6)]
    df = spark.createDataFrame(rows, "p string, o long, s long").repartition(5)
    got = [tuple(r) for r in windows.chunks_by_size(df, "p", "o", F.col("s"), limit).collect()]
    assert sorted(got, key=str) == chunks_by_force(rows, limit)
    assert windows.chunks_by_size(df.where("false"), "p", "o", F.col("s"), limit).count() == 0


def test_chunks_null_size(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, None, 6, 6])], "p string, o long, s long")
    assert [r.chunk for r in windows.chunks_by_size(df, "p", "o", F.col("s"), 10).orderBy("o").collect()] == [0, 0, 1, 2]


def test_quality(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, -1.0)], "k int, v double")
    got = {r.check: (r.n_bad, r.status) for r in quality.check_rows(df, {"positive": F.col("v") > 0}).unionByName(quality.unique_key(df, ["k"], "unique")).collect()}
    assert got == {"positive": (2, "FAIL"), "unique": (1, "FAIL")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "raw_pn string")
    assert convert.convert_forward(decode.parse_strict(empty)).count() == 0
    assert validate.mates(decode.parse_strict(empty)).count() == 0


def test_merged_bins_equal_plain_python(spark):
    import random

    rng = random.Random(2)
    rows = [(g, float(b), rng.randint(1, 9)) for g in range(4) for b in rng.sample(range(100), rng.randint(1, 9))]
    got = sorted((r.g, round(r.mean, 6), r.n) for r in drawing.merge_bins(spark.createDataFrame(rows, "g long, bin double, n long"), "g", 3).collect())
    want = []
    for g in range(4):
        bins = sorted((b, [b] * n) for x, b, n in rows if x == g)
        members = [m for _, m in bins]
        mean = lambda m: sum(m) / len(m)
        while len(members) > 3:
            i = min(range(len(members) - 1), key=lambda i: mean(members[i + 1]) - mean(members[i]))
            members[i : i + 2] = [members[i] + members[i + 1]]
        want += [(g, round(mean(m), 6), len(m)) for m in members]
    assert got == sorted(want)


def test_point_clusters(spark):
    rows = [(1, 1, 0.0, 0.0, 4.0), (1, 2, 1.0, 0.0, 2.0), (1, 3, 9.0, 9.0, 3.0), (1, 4, 2.5, 0.0, 1.0), (2, 5, 0.0, 0.0, 1.0)]
    got = drawing.cluster_points(spark.createDataFrame(rows, "g long, id long, x double, y double, r double"), "g").orderBy("g", "n").collect()
    assert [(r.g, r.n) for r in got] == [(1, 1), (1, 1), (1, 2), (2, 1)] or [(r.g, r.n) for r in got] == [(1, 1), (1, 3), (2, 1)]


def test_convert_any_modes(spark):
    df = spark.createDataFrame([("D38999/26WD35PN",), ("KJA6T15W35PN",), ("RJF-6A",), ("nothing",), (None,)], "number string")
    got = {(r.number, r.mode) for r in dispatch.convert_any(df, "number").collect()}
    assert got == {("D38999/26WD35PN", "standard"), ("KJA6T15W35PN", "vendor"), ("RJF-6A", "rugged"), ("nothing", "error"), (None, "error")}
    ranked = dispatch.ranked_reverse(spark.createDataFrame([("KJA6T15W35PN",)], "vendor_pn string")).collect()
    assert (ranked[0].place, ranked[0].normalized) == (1, "D38999/26WD35PN")
