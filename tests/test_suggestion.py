"""Serving needs from arrangements against plain Python, and joins on ranges against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators import electrical, ranges, requirements, suggestion

RATED = {s: a for s, a, *_ in R.RATINGS}
POWER = ["12", "16", "20", "22D"]


def factor(n):
    if n <= 1:
        return 1.0
    for (a, fa), (b, fb) in zip(electrical.KNOTS, electrical.KNOTS[1:]):
        if n <= b:
            return (fa * (b - a) - (n - a) * (fa - fb)) / (100 * (b - a))
    return R.DERATING[-1][1]


def forced(amps, size, other):
    for n in range(1, 21):
        each = RATED[size] * factor(other + n)
        if n * each * 100 >= amps * 125 and (amps <= 13 or (n >= 2 and (n - 1) * each >= amps)):
            return n
    return None


def plain(needs, have):
    rest, used, uses = dict(have), 0, []
    for size, c, amps, rails in needs:
        order = suggestion.SIZE_ORDER
        larger = order[order.index(size) + 1 :] if size in order else []
        tries = [(size, c, "exact")] + [(s, c, "upsized") for s in larger]
        if rails:
            tries += [(s, forced(amps, s, used) * rails, "split") for s in POWER if s != size and forced(amps, s, used)]
        for at, n, kind in tries:
            if rest.get(at, 0) >= n:
                if at in rest:
                    rest[at] -= n
                used += n
                uses.append((size, at, n, kind))
                break
        else:
            return None
    return uses, {k: v for k, v in rest.items()}


def test_serve(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        sizes = rng.sample(["22D", "20", "16", "12", "8", "12 Coax", "odd"], rng.randint(1, 5))
        needs = [(s, rng.randint(0, 9), *((float(rng.randint(1, 40)), rng.randint(1, 3)) if rng.random() < 0.5 else (None, 0))) for s in sizes]
        have = {s: rng.randint(0, 25) for s in rng.sample(["22D", "22", "20", "16", "12", "8", "4", "12 Coax", "odd"], rng.randint(1, 6))}
        rows.append((i, needs, have))
    df = spark.createDataFrame(rows, "i int, needs array<struct<size:string,contacts:bigint,rail_amps:double,rails:bigint>>, have map<string,bigint>")
    kinds = set()
    for r in suggestion.serve(df, "needs", "have").withColumn("least", suggestion.least_contacts("needs")).collect():
        want = plain(rows[r.i][1], rows[r.i][2])
        assert r.served.fits == (want is not None), rows[r.i]
        if want:
            assert ([tuple(u) for u in r.served.uses], r.served.rest) == want
            assert r.least <= sum(rows[r.i][2].values())  # the prefilter drops none that fits
            kinds |= {u.kind for u in r.served.uses}
    assert kinds == {"exact", "upsized", "split"}


def test_needs_in_order(spark):
    rows = [(1, 0, "uart", 2, 0.0), (1, 1, "power", 2, 20.0), (1, 2, "discrete", 3, 0.0), (2, 0, "power", 1, 5.0), (2, 1, "power_return", 1, 5.0), (3, 0, "coax", 1, None)]
    df = spark.createDataFrame(rows, "request int, pos int, function string, count int, amps double")
    got = {r.request: [tuple(n) for n in r.needs] for r in suggestion.needs_in_order(requirements.expand(df)).collect()}
    assert got[1][0] == ("22D", 9, None, 0) and got[1][1][2:] == (20.0, 4)
    assert len(got[2]) == 1 and got[2][0][2:] == (5.0, 1)
    assert got[3] == [("12 Coax", 1, None, 0)]


def test_suggest_edges(spark):
    """No arrangement that fits, no arrangement, no request."""
    asked = spark.createDataFrame([(1, 0, "coax", 3, 0.0), (2, 0, "uart", 1, 0.0)], "request int, pos int, function string, count int, amps double")
    made = spark.createDataFrame([("a", "22D", 5), ("b", "22D", 5), ("c", "22D", 2)], "key string, size string, count int")
    rows = suggestion.suggest(asked, made, "key").collect()
    assert sorted((r.request, r.place, r.key) for r in rows if r.place) == [(2, 1, "a"), (2, 2, "b")]
    assert [(r.request, r.place) for r in rows if not r.place] == [(1, None)]
    assert suggestion.suggest(asked.limit(0), made, "key").collect() == []
    assert {r.place for r in suggestion.suggest(asked, made.limit(0), "key").collect()} == {None}


def test_at_least(spark):
    a = spark.range(0, 70).select(F.col("id").alias("need")).union(spark.sql("SELECT NULL UNION ALL SELECT 1000000000"))
    b = spark.range(0, 70).select(F.col("id").alias("have")).union(spark.sql("SELECT NULL UNION ALL SELECT 2147483647"))
    got = sorted((r.need, r.have) for r in ranges.at_least(a, b, "need", "have").collect())
    assert got == sorted((n, h) for n in [*range(70), 10**9] for h in [*range(70), 2**31 - 1] if h >= max(n, 1))


def test_in_spans(spark):
    rng = random.Random(1)
    points = [(rng.choice(["a", "b", None]), rng.randint(-50, 50)) for _ in range(200)]
    spans = [(rng.choice(["a", "b", None]), x := rng.randint(-60, 60), x + rng.randint(-1, 40)) for _ in range(40)]
    p = spark.createDataFrame(points, "g string, v long")
    s = spark.createDataFrame(spans, "g string, lo long, hi long")
    got = sorted((str(r.g), r.v, r.lo, r.hi) for r in ranges.in_spans(p, s, "g", "v", "lo", "hi", 16).collect())
    assert got == sorted((str(g), v, lo, hi) for g, v in points for k, lo, hi in spans if k == g and lo <= v <= hi)


@pytest.mark.parametrize("salt", [1, 3])
def test_overlapping(spark, salt):
    rng = random.Random(2)

    def boxes(n):
        out = [(i, "p", x := rng.uniform(-20, 20), y := rng.uniform(-20, 20), x + rng.uniform(0, 9), y + rng.uniform(0, 9)) for i in range(n)]
        out += [(n, "p", 0.0, 0.0, 4.0, 4.0), (n + 1, "p", 4.0, 0.0, 8.0, 4.0), (n + 2, "p", 1.0, 1.0, 1.0, 3.0), (n + 3, "q", 0.0, 0.0, 4.0, 4.0)]
        return out + [(n + 4, "p", None, 0.0, 1.0, 1.0), (n + 5, "p", float("nan"), 0.0, 1.0, 1.0)]

    a, b = boxes(60), boxes(60)
    schema = "id int, g string, x0 double, y0 double, x1 double, y1 double"
    got = sorted((r.a, r.b) for r in ranges.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "g", 4.0, salt).collect())
    real = lambda r: all(v is not None and v == v for v in r) and r[2] < r[4] and r[3] < r[5]
    want = [(p[0], q[0]) for p in a if real(p) for q in b if real(q) and p[1] == q[1] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]]
    assert got == sorted(want)
