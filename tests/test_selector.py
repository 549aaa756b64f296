import pytest
from pyspark.sql import functions as F

from partlake.operators import convert, listing, selector

CATALOG = "id long, a string, b string"
ASKED = "k long, a string, b string"


def walk(spark, catalog, asked):
    out = selector.walk_selection(spark.createDataFrame(asked, ASKED), "k", spark.createDataFrame(catalog, CATALOG), ["a", "b"], "id")
    return {r.k: (r.chosen, r.reached, r.broken, r.exact, r.matches) for r in out.collect()}


def test_walk(spark):
    catalog = [(1, "x", "1"), (2, "x", "2"), (2, "x", "2"), (3, "y", "1")]
    asked = [(0, None, None), (1, "x", None), (2, "x", "2"), (3, "x", "9"), (4, "z", "1"), (5, None, "1")]
    assert walk(spark, catalog, asked) == {
        0: (0, 0, False, False, 3),
        1: (1, 1, False, False, 2),
        2: (2, 2, False, True, 1),
        3: (2, 1, True, False, 0),
        4: (2, 0, True, False, 0),
        5: (1, 0, True, False, 0),
    }
    assert walk(spark, [], asked[:2]) == {0: (0, 0, False, False, 0), 1: (1, 0, True, False, 0)}
    assert walk(spark, catalog, []) == {}


def test_value_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("A",), ("09",), ("1-2",)], "v string")
    assert [r.v for r in df.orderBy(selector.value_key(F.col("v"))).collect()] == ["09", "9", "10", "1-2", "A"]


def test_counters(spark):
    df = spark.createDataFrame([("Page 2 of 1,300",), ("nothing",), (None,)], "t string")
    pattern = r"Page (\d+) of ([\d,]+)"
    assert [r.n for r in df.select(listing.counter(F.col("t"), pattern, 2).alias("n")).collect()] == [1300, None, None]
    with pytest.raises(Exception, match="no counter"):
        df.where("t = 'nothing'").select(listing.counter(F.col("t"), pattern, 1, True)).collect()


def test_padded_rows_of_nulls_and_none(spark):
    df = spark.createDataFrame([("abc", None), (None, "z")], "a string, b string")
    titles = {"a": "A", "b": "Bee"}
    assert [r.line for r in listing.padded_rows(df, titles).orderBy("b").collect()] == ["abc", "     z"]
    assert listing.padded_rows(df.limit(0), titles).count() == 0


def test_superseded(spark):
    df = spark.createDataFrame([("q1_n.json",), ("q1_d.json",), ("q2_n.json",), ("q2_n.json",), (None,)], "name string")
    assert [r.name for r in listing.without_superseded(df, "name", "_n.json", "_d.json").collect()] == ["q2_n.json"]


def test_reverse_of_odd_numbers(spark):
    df = spark.createDataFrame([(None,), ("",), ("a,b,c,d,e",), ("D38999",)], "vendor_pn string")
    assert convert.convert_reverse(df).count() == 0
