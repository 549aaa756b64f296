"""Small tests of faults found by review, by the query's name."""

from __spark_entry__ import plans  # isort: skip
from oracle import SF
from partlake.operators import drawing, nested, relaxation, trees
from partlake.plans import deep, queries
from partlake.streaming import recent
from pyspark.sql import Row


def test_batch_entries(spark):
    """Digits of an entry's number are no blanks; space separators are."""
    text = "0a\n12b; 2c \t　3d 3\r\n  "
    got = spark.createDataFrame([(text,)], "x string").select(nested.split_batch("x")).first()[0]
    assert got == ["0a", "12b", "2c", "3d 3"]


def test_human_summaries(spark):
    """Rows of a small file go to all tasks, and no sentence is worked out again for each use."""
    out = plans.QUERIES["human_summaries"](spark, SF)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = out._jdf.queryExecution().analyzed().toString()
    assert text.count("repeat(Acme") == 1


def test_deep_documents(spark):
    """Documents of a small table go to all tasks; texts that are no JSON are left out of the walk."""
    docs = deep.nested_documents(spark, SF)
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    odd = spark.createDataFrame([(1, "{no"), (2, None), (3, '{"pn":"D38999/1"}')], "id long, doc string")
    assert [tuple(r) for r in trees.texts_under(trees.walk(odd, "id", "doc"), "id", ["pn"], "D38999/").collect()] == [(3, "D38999/1")]


def test_relaxed_families(spark):
    """Requests that wish the same, nulls too, are one request of ``relax``."""
    r = spark.createDataFrame([(7, "a", None), (3, "a", None), (5, "a", 1), (9, None, 1)], "request long, x string, least int")
    different, asked = relaxation.numbered_wishes(r, ["x", "least"])
    assert sorted(x.request for x in different.collect()) == [3, 5, 9]
    assert sorted((x.request, x.wish) for x in asked.collect()) == [(3, 3), (5, 5), (7, 3), (9, 9)]


def test_contact_sizes(spark):
    """Bins of many faces are merged in a batch; a null face is a face, means of no value come last."""
    rows = [(1, 0.1, 2), (1, 0.2, 2), (1, 0.5, 1), (None, 0.3, 4), (None, 0.1, 1)]
    out = drawing.merge_bins(spark.createDataFrame(rows, "g long, bin double, n long"), "g", 2)
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.g or 0, round(r.mean, 6), r.n) for r in out.collect())
    assert got == [(0, 0.1, 1), (0, 0.3, 4), (1, 0.15, 4), (1, 0.5, 1)]


def test_sources_cross_checked(spark):
    """The feed is parsed ahead of the joins that ask for it, and numbers are told apart by hashing, not by sorting."""
    out = plans.QUERIES["sources_cross_checked"](spark, SF)
    assert not any("lineitem" in f for f in out.inputFiles())
    assert "SortAggregate" not in queries.distinct_parsed(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_convert_modes(spark):
    """Numbers are parsed ahead of the branches that ask for them."""
    assert not any("lineitem" in f for f in plans.QUERIES["convert_modes"](spark, SF).inputFiles())


def test_recent_stream():
    """A user's state is one value, read and written once a micro-batch."""
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, v):
            calls.append("update")
            self.held = v

    class Handle:
        def getValueState(self, *args):
            return Value()

    p = recent.RecentList(2)
    p.init(Handle())
    for at, pin in ((1, False), (2, True), (3, False)):
        rows = list(p.handleInputRows((7,), [Row(name=f"n{at}", at=at, pin=pin)], None))
    assert calls == ["get", "update"] * 3
    assert [(r.version, r.place, r.name, r.pinned) for r in rows] == [(3, 1, "n2", True), (3, 2, "n3", False), (3, 3, "n1", False)]
