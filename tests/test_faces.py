"""Labels, sizes and numbers of faces against plain Python, with nulls, ties, empty tables and hot groups."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from partlake.operators import faces
from partlake.operators.ranking import numbered

P = "face string, id int, x double, y double, label string"


def test_carry_labels(spark):
    """The fit and the cheapest assignment by all permutations; faces that cannot be fitted have no rows."""
    rng = random.Random(3)
    points, reference = [], []
    for f in range(12):
        n = rng.randint(2, 6)
        ref = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(n)]
        points += [(f"f{f}", i, 5 + 3 * x + rng.uniform(-0.3, 0.3), 2 - 4 * y + rng.uniform(-0.3, 0.3), rng.choice(["?", None, "A", "B"])) for i, (x, y) in enumerate(ref)]
        reference += [(f"f{f}", i, x, y, "ABCDEF"[i]) for i, (x, y) in enumerate(ref)]
    points += [("more", 0, 0.0, 0.0, "?"), ("flat", 0, 0.0, 0.0, "?"), ("flat", 1, 1.0, 1.0, "?"), ("alone", 0, 1.0, 1.0, "?")]
    reference += [("more", 0, 0.0, 0.0, "A"), ("more", 1, 1.0, 1.0, "B"), ("flat", 0, 0.0, 2.0, "A"), ("flat", 1, 1.0, 2.0, "B")]
    p, r = spark.createDataFrame(points, P), spark.createDataFrame(reference, P)
    rows = {(x.face, x.id): x for x in faces.carry_labels(p, r, "face", within=0.6).collect()}
    want = 0
    for f in {x[0] for x in points} - {"more", "flat", "alone"}:
        a, b = [x for x in points if x[0] == f], [x for x in reference if x[0] == f]
        ext = [(min(v), max(v)) for v in ([x[2] for x in a], [x[3] for x in a], [x[2] for x in b], [x[3] for x in b])]
        (ax0, ax1), (ay0, ay1), (bx0, bx1), (by0, by1) = ext
        sx, sy = (ax1 - ax0) / (bx1 - bx0), (ay1 - ay0) / (by1 - by0)
        t = [((ax0 + ax1) / 2 + sx * (x[2] - (bx0 + bx1) / 2), (ay0 + ay1) / 2 - sy * (x[3] - (by0 + by1) / 2)) for x in b]
        d2 = lambda i, j: (t[i][0] - a[j][2]) ** 2 + (t[i][1] - a[j][3]) ** 2
        best = min(permutations(range(len(a))), key=lambda q: sum(d2(i, j) for i, j in enumerate(q)))
        for i, j in enumerate(best):
            got, found, new = rows[f, a[j][1]], a[j][4], b[i][4]
            far = d2(i, j) ** 0.5 > 0.6
            assert got.label == (found if far else new) and got.distance == pytest.approx(d2(i, j) ** 0.5)
            assert got.status == ("far" if far else "filled" if found in ("?", None) else "same" if found == new else "corrected")
            want += 1
    assert len(rows) == want
    total = faces.label_summary(faces.carry_labels(p, r, "face"), "face").agg(F.sum(F.col("filled") + F.col("corrected"))).first()[0]
    assert total == sum(1 for x in rows.values() if x.found in ("?", None) or x.status in ("corrected", "far"))
    assert faces.carry_labels(p.limit(0), r, "face").collect() == []


def test_too_many_points(spark, monkeypatch):
    monkeypatch.setattr(faces, "MOST_POINTS", 3)
    p = spark.createDataFrame([("f", i, float(i), float(i), "?") for i in range(4)], P)
    with pytest.raises(Exception, match="points of a face: 4"):
        faces.fit_axes(p, p, "face").collect()


def plain_sizes(points, notes):
    order = faces.SIZE_ORDER
    at = lambda s: order.index(s) if s in order else 99
    asc = sorted(points, key=lambda p: (p[1], -p[0]))
    if not notes:
        return {i: (None, "none") for i, _ in points}
    if len(notes) == 1:
        return {i: (notes[0][0], "single") for i, _ in points}
    bins = {}
    for _, d in asc:
        bins.setdefault(round(d, 2), []).append(d)
    bins = [[round(sum(v) / len(v), 6), len(v)] for _, v in sorted(bins.items())]
    while len(bins) > len(notes):
        i = min(range(len(bins) - 1), key=lambda j: bins[j + 1][0] - bins[j][0])
        (a, m), (b, n) = bins[i : i + 2]
        bins[i : i + 2] = [[(a * m + b * n) / (m + n), m + n]]
    want, seen = sorted(notes, key=lambda x: at(x[0])), [n for _, n in bins]
    if [c for _, c in want] == seen:
        spans, how = want, "bins"
    elif sorted(c for _, c in want) == sorted(seen):
        left, spans, how = list(want), [], "counts"
        for n in seen:
            spans.append(left.pop(next(i for i, x in enumerate(left) if x[1] == n)))
    elif sum(c for _, c in want) == len(points):
        spans, how = sorted(notes, key=lambda x: -at(x[0]))[::-1], "ranked"
    else:
        return {i: (None, "ambiguous") for i, _ in points}
    sizes = [s for s, c in spans for _ in range(c)]
    return {i: (s, how) for (i, _), s in zip(asc, sizes)}


def test_assign_sizes(spark):
    rng = random.Random(6)
    groups = {}
    for g in range(60):
        ds = [rng.choice([0.5, 0.51, 0.8, 1.2, 1.25, 2.0]) for _ in range(rng.randint(1, 9))]
        kinds = rng.randint(0, 3)
        sizes = rng.sample(["22D", "20", "16", "12", "8 Twinax", "8 Coax"], kinds)
        cuts = sorted(rng.randint(0, len(ds)) for _ in range(kinds - 1)) if kinds else []
        counts = [b - a for a, b in zip([0, *cuts], [*cuts, len(ds)])] if kinds else []
        if rng.random() < 0.2 and counts:
            counts[0] += 1
        groups[g] = ([(i, d) for i, d in enumerate(ds)], list(zip(sizes, counts)))
    groups[100] = ([(i, d) for i, d in enumerate([1.0, 1.0, 1.0, 3.0, 3.0, 5.0])], [("12", 3), ("22D", 2), ("20", 1)])  # counts in another order
    groups[101] = ([(i, d) for i, d in enumerate([1.0, 1.0, 3.0])], [("22D", 2), ("16", 1)])
    p = spark.createDataFrame([(g, i, d) for g, (ps, _) in groups.items() for i, d in ps], "face int, id int, diameter double")
    n = spark.createDataFrame([(g, k, s, c) for g, (_, ns) in groups.items() for k, (s, c) in enumerate(ns)], "face int, pos int, size string, count int")
    got = {(r.face, r.id): (r.size, r.how) for r in faces.assign_sizes(p, n, "face").collect()}
    want = {(g, i): v for g, (ps, ns) in groups.items() for i, v in plain_sizes(ps, ns).items()}
    assert got == want
    assert {"none", "single", "bins", "counts", "ranked", "ambiguous"} == {h for _, h in want.values()}


def plain_unique(labels):
    """The walk in order, with names seen and names taken."""
    seen, taken, out = {}, {x for x in labels if x not in ("?", None)}, []
    for x in labels:
        if x in ("?", None):
            out.append((x, None))
            continue
        before = seen.get(x, 0)
        seen[x] = before + 1
        if before == 0:
            out.append((x, "first"))
        elif len(x) == 1 and x.isalpha() and x.isupper():
            n = before + 1
            while x * n in taken:
                n += 1
            taken.add(x * n)
            out.append((x * n, "renamed"))
        else:
            out.append((x, "ambiguous"))
    return out


def test_unique_labels(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for g in [*range(30), None]:
        labels = [rng.choice(["A", "A", "B", "AA", "AAAA", "BBB", "a", "12", "?", None, "É", "ÉÉ", "AB"]) for _ in range(rng.randint(1, 25))]
        rows += [(g, i, x) for i, x in enumerate(labels)]
        want |= {(g, i): v for i, v in enumerate(plain_unique(labels))}
    df = spark.createDataFrame(rows, "g int, i int, label string")
    got = {(r.g, r.i): (r.unique, r.status) for r in faces.unique_labels(df, "g", "label", ["i"]).collect()}
    assert got == want
    names = [(k[0], v[0]) for k, v in got.items() if v[1] in ("renamed",)]
    assert len(names) == len(set(names))


def test_numbered(spark):
    """A hot group over many ranges, null groups, no group at all, repeated rows."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 50)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    for part in (["g"], []):
        got = numbered(df, part, [F.desc("v")]).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.g if part else 0, []).append((r.place, r.v))
        assert sum(map(len, groups.values())) == 500
        for g in groups.values():
            g.sort()
            assert [p for p, _ in g] == list(range(1, len(g) + 1)) and [v for _, v in g] == sorted((v for _, v in g), reverse=True)
    assert numbered(df.limit(0), ["g"], ["v"]).collect() == []
