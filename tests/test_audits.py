"""Audits and summaries on small cases: spoilt arrangements, odd numbers, other sources, nulls and empty tables."""

from pyspark.sql import functions as F

from partlake.functions import labels
from partlake.operators import audits, htmlscan, lookups


def test_check_arrangements(spark):
    a = [("9-1", "9", "A", "1", 2, 2), ("9-1", "9", "A", "1", 2, None), ("11-2", "11", "A", "2", 1, 1), ("13-5", "13", "?", "7", 0, None), (None, None, None, None, None, None)]
    c = [("9-1", "A", 1.0, 1.0, "20"), ("9-1", "A", None, 1.0, "20"), ("11-2", None, 1.0, 1.0, "odd"), ("lost", "?", 1.0, 1.0, None)]
    arrangements = spark.createDataFrame(a, "id string, shell string, code string, number string, contact_count int, expected_count int")
    contacts = spark.createDataFrame(c, "id string, label string, x double, y double, size string")
    got = {r.check: (r.n_rows, r.n_bad, r.status) for r in audits.check_arrangements(arrangements, contacts, ["20"], 5, 3).collect()}
    assert got == {
        "id reads shell-number": (5, 2, "FAIL"), "shell is its code's": (5, 1, "FAIL"), "contacts as counted": (5, 1, "FAIL"), "contacts as expected": (5, 0, "PASS"),
        "labels there": (5, 1, "FAIL"), "labels unique": (5, 2, "FAIL"), "id unique": (5, 1, "FAIL"), "contact placed": (4, 1, "FAIL"), "contact size rated": (4, 2, "FAIL"),
        "number of arrangements": (5, 0, "PASS"), "number of contacts": (4, 1, "FAIL"),
    }
    empty = audits.check_arrangements(arrangements.limit(0), contacts.limit(0), ["20"]).collect()
    assert {r.n_bad for r in empty if r.check != "id unique"} == {0}


def test_check_numbers(spark):
    cases = [
        (("D38999/26WB35PN", "26", "W", "B", "P", "N", None, None), ("insert", None)),
        (("D38999/26WB35PN", "24", "W", "B", "P", "N", None, None), ("insert", "sheet differs")),
        (("D38999/26WB35PN", "26", "F", "B", "P", "N", None, None), ("insert", "class differs")),
        (("D38999/26WB35SN", "26", "W", "B", "P", "N", None, None), ("insert", "contact differs")),
        (("D38999/26WB35QN", None, None, None, None, None, None, None), ("insert", "contact not documented")),
        (("D38999/26KB35PN", None, None, None, None, None, None, None), ("insert", "unknown class")),
        (("D38999/26W", "26", "W", None, None, None, None, None), ("insert", "no insert pattern")),
        (("D38999/32W11N", "32", "W", "11", None, "N", None, None), ("accessory", None)),
        (("D38999/32X11N", "32", "X", "11", None, "N", None, None), ("accessory", "unknown class")),
        (("D38999/26WA10PN5", "26", "W", "Z", "P", "N", "A", "5"), ("variant", "unknown size")),
        (("MS27", "26", None, None, None, None, None, None), ("insert", "no sheet")),
    ]
    df = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(cases)], "i int, pn string, sheet string, class string, size string, contact string, key string, lanyard string, type string")
    got = {r.i: (r.kind, r.problem) for r in audits.check_numbers(df, "pn", ["W", "F"], ["P", "S"]).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_check_families(spark):
    families = [(0, "233-105", "mighty", "x"), (1, "233", "wide", "x"), (2, "233-106", "late", "x")]
    df = spark.createDataFrame([("233-105-G6",), ("233-106-1",), ("233-107-1",), ("23 3-x",), ("9",), (None,)], "n string")
    got = {r.n: r.verdict for r in audits.check_families(df, "n", families).collect()}
    assert got == {"233-105-G6": "ok", "233-106-1": "other series", "233-107-1": "unknown base", "23 3-x": "ok", "9": "not recognised", None: "not recognised"}


def test_cross_check(spark):
    e = spark.createDataFrame([("a", "26", "P", "N"), ("a", "26", "P", "N"), ("b", "26", "X", "N"), ("c", None, None, None), (None, "26", "P", "A")], "n string, sheet string, contact string, position string")
    v = spark.createDataFrame([("a", "m2"), ("a", "m1"), ("c", None)], "n string, maker string")
    c = spark.createDataFrame([("26", ["P", "S"], ["N"], "s1"), ("26", ["P"], ["N", "A"], "s2"), ("26", ["P"], ["N"], None), ("26", [], ["N"], "s3")], "sheet string, contacts array<string>, positions array<string>, source string")
    got = sorted((str(r.n), r.verified, r.maker, tuple(r.sources), r.importable) for r in audits.cross_check(e, v, c, "n").collect())
    assert got == [("None", False, "", ("s2",), True), ("a", True, "m1", ("s1", "s2"), True), ("a", True, "m1", ("s1", "s2"), True), ("b", False, "", (), False), ("c", True, "", (), False)]


def test_supported_sources_of_like_rows(spark):
    """Catalog rows that ask for the same are one question."""
    d = spark.createDataFrame([("q", "26", "P", "N"), ("r", "99", "P", "N")], "k string, sheet string, contact string, key string")
    c = spark.createDataFrame([(i, "26", None if i % 2 else "24", ["P"], [], "s" if i % 3 else "t") for i in range(50)], "row_id int, style string, equivalent string, contacts array<string>, keys array<string>, source string")
    assert {r.k: r.sources for r in lookups.supported_sources(d, c, "k").collect()} == {"q": ["s", "t"], "r": []}


def test_detail_rows(spark):
    page = '<span id="a_ctl05_lblCompany"><i>A &amp; B</i></span><span id="a_ctl05_lblMfgPart">X1 - (old)</span><img id="a_ctl05_imgX" alt="Certified"><span id="a_ctl6_lblCountry">US</span>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "no cells")], "id int, html string")
    rows = [tuple(r) for r in htmlscan.detail_rows(df, "id", "html").collect()]
    assert rows == [(1, 5, "", "A & B", "", "X1", "old", "certified")]


def test_summaries(spark):
    df = spark.createDataFrame(
        [(1, "straight plug", "13", "13-35", "P", "Straight_Plug", "Good.  More.", None, None), (2, None, None, None, "?", None, None, [("high_temp", 5), ("emi", 3)], None), (3, "", "", "", None, "x" * 600, "", [], ["a_b", "A-b", "c", "d"])],
        "i int, style string, shell string, arrangement string, contact string, description string, note string, scores array<struct<name:string,score:int>>, tags array<string>",
    )
    service = audits.environment_sentence("note", "scores", "tags")
    out = {r.i: r for r in df.select("i", service.alias("s"), audits.human_summary("style", "shell", "arrangement", labels.contact_summary("contact"), "description", F.lit(None).cast("string"), service).alias("t")).collect()}
    assert [out[i].s for i in (1, 2, 3)] == ["Good.", "The loaded data points to high temp service.", "Environment tags include A B, C, and D."]
    assert out[1].t == "straight plug, shell size 13, insert arrangement 13-35, using pin contacts. Straight_Plug. Good."
    assert out[2].t == "Connector, shell size not specified, insert arrangement is not specified. The loaded data points to high temp service. Contact gender is not specified."
    assert len(out[3].t) == 420 and out[3].t.endswith("...")


def test_interfaces(spark):
    e = spark.createDataFrame([("f", "RJ45", "Glenair", None, "9"), ("g", "USB", None, "rel", "11"), (None, None, None, None, None)], "family string, interface string, vendor string, relation string, shell string")
    assert [r.family for r in audits.interface_filter(e, vendor="Glenair").collect()] == ["f"]
    assert [r.family for r in audits.interface_filter(e, word="REL").collect()] == ["g"]
    assert audits.interface_filter(e).count() == 3
    got = sorted((r.facet, r.place, r.value) for r in audits.interface_facets(e, ["USB", "RJ45 / Ethernet", "HDMI", "Other"]).collect())
    assert got == [("category", 0, "USB"), ("category", 1, "RJ45 / Ethernet"), ("category", 2, "Other"), ("shell", 0, "9"), ("shell", 1, "11"), ("vendor", 0, "Glenair"), ("vendor", 1, "Other")]
