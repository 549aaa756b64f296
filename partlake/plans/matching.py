"""Queries on points, labels and boxes of connector faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake.operators import faces, ranges
from partlake.operators.suggestion import SIZE_ORDER
from partlake.plans.queries import _LIST, query, table


def _at(i: int):
    return F.element_at("embedding", i).cast("double")


def face_points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Faces of five points: even vectors are contacts, odd ones their reference."""
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(F.floor(v / 10).alias("face"), v.alias("id"), _at(1).alias("x"), _at(2).alias("y"), F.char(65 + F.floor(v / 2) % 5).alias("letter"))
    own = e.where("id % 2 = 0").select("face", "id", "x", "y", F.when(F.col("id") % 4 == 0, "?").otherwise(F.col("letter")).alias("label"))
    return own, e.where("id % 2 = 1").select("face", "id", "x", "y", F.col("letter").alias("label"))


_PERMUTED = """
  e AS (SELECT vec_id // 10 AS face, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, chr((65 + vec_id // 2 % 5)::INT) AS letter FROM embeddings),
  c AS (SELECT face, list(id ORDER BY id) AS ids, list(x ORDER BY id) AS xs, list(y ORDER BY id) AS ys,
        list(CASE WHEN id % 4 = 0 THEN '?' ELSE letter END ORDER BY id) AS labels FROM e WHERE id % 2 = 0 GROUP BY face),
  r AS (SELECT face, list(x ORDER BY id) AS u, list(y ORDER BY id) AS v, list(letter ORDER BY id) AS names FROM e WHERE id % 2 = 1 GROUP BY face),
  f AS (SELECT *, (list_max(xs) - list_min(xs)) / (list_max(u) - list_min(u)) AS sx, (list_max(ys) - list_min(ys)) / (list_max(v) - list_min(v)) AS sy
        FROM c JOIN r USING (face) WHERE len(xs) = len(u) AND list_max(u) > list_min(u) AND list_max(v) > list_min(v)),
  g AS (SELECT *, (list_min(xs) + list_max(xs)) / 2 - sx * ((list_min(u) + list_max(u)) / 2) AS ox, (list_min(ys) + list_max(ys)) / 2 + sy * ((list_min(v) + list_max(v)) / 2) AS oy FROM f),
  p AS (SELECT []::INT[] AS p UNION ALL SELECT list_append(p, i) FROM p, range(1, 6) t(i) WHERE len(p) < 5 AND NOT list_contains(p, i)),
  k AS (SELECT face, any_value(ids) AS ids, any_value(labels) AS labels, any_value(names) AS names,
          arg_min(p, list_sum(list_transform(range(1, len(p) + 1), lambda i: (ox + sx * u[i] - xs[p[i]]) ** 2 + (oy - sy * v[i] - ys[p[i]]) ** 2))) AS p,
          min_by(list_transform(range(1, len(p) + 1), lambda i: sqrt((ox + sx * u[i] - xs[p[i]]) ** 2 + (oy - sy * v[i] - ys[p[i]]) ** 2)),
                 list_sum(list_transform(range(1, len(p) + 1), lambda i: (ox + sx * u[i] - xs[p[i]]) ** 2 + (oy - sy * v[i] - ys[p[i]]) ** 2))) AS d
        FROM g JOIN p ON len(p) = len(ids) AND list_max(p) = len(ids) GROUP BY face),
  m AS (SELECT face, unnest(list_transform(p, lambda j: ids[j])) AS id, unnest(list_transform(p, lambda j: labels[j])) AS found, unnest(names) AS name, unnest(d) AS d FROM k),
  s AS (SELECT face, id, found, CASE WHEN d > 0.2 THEN found ELSE name END AS label,
          CASE WHEN d > 0.2 THEN 'far' WHEN found = '?' THEN 'filled' WHEN found <> name THEN 'corrected' ELSE 'same' END AS status, round(d, 6) AS distance FROM m)
"""


@query(f"WITH RECURSIVE {_PERMUTED} SELECT * FROM s")
def reference_labels(spark, sf_dir):
    """Reference labels carried to the points of each face; the SQL tries all permutations."""
    return faces.carry_labels(*face_points(spark, sf_dir), "face", within=0.2).withColumn("distance", F.round("distance", 6))


@query(f"WITH RECURSIVE {_PERMUTED} SELECT face, count(*) FILTER (status = 'filled') AS filled, count(*) FILTER (status = 'corrected') AS corrected, count(*) FILTER (status = 'far') AS far, max(distance) AS max_distance FROM s GROUP BY face")
def reference_label_summary(spark, sf_dir):
    return faces.label_summary(reference_labels(spark, sf_dir), "face")


def sized_points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines of a part as contacts, discounts as diameters; titles by what the part's number leaves of six."""
    li = table(spark, sf_dir, "lineitem")
    points = li.select(F.col("l_partkey").alias("face"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("id"), F.col("l_discount").alias("diameter"))
    d, k = F.col("l_discount"), F.col("l_partkey") % 6
    per = li.groupBy(F.col("l_partkey").alias("face"), k.alias("k")).agg(F.count("*").alias("n"), F.count_if(d < 0.055).alias("low"), F.count_if(d < 0.025).alias("least"))
    note = lambda pos, size, count: F.struct(F.lit(pos).alias("pos"), F.lit(size).alias("size"), count.cast("long").alias("count"))
    n, low, least = F.col("n"), F.col("low"), F.col("least")
    notes = (
        F.when(F.col("k") == 0, F.array(note(0, "20", n + 3)))
        .when(F.col("k") == 1, F.array(note(0, "16", n - low), note(1, "22D", low)))
        .when(F.col("k") == 2, F.array(note(0, "22D", n - low), note(1, "8 Twinax", low)))
        .when(F.col("k") == 3, F.array(note(0, "20", F.floor(n / 3)), note(1, "22D", F.floor(n / 4)), note(2, "12", n - F.floor(n / 3) - F.floor(n / 4))))
        .when(F.col("k") == 4, F.array(note(0, "20", n), note(1, "odd", n), note(2, "odder", n)))
    )
    return points, per.select("face", F.explode(notes).alias("s")).select("face", "s.*")


_ORDER = f"coalesce(nullif(list_position([{_LIST(SIZE_ORDER)}], size), 0), 99)"


@query(f"""
  WITH RECURSIVE l AS (SELECT l_partkey AS face, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount AS d FROM lineitem),
  n AS (SELECT face, count(*) AS n, count(*) FILTER (d < 0.055) AS low FROM l GROUP BY face),
  t AS (
    SELECT face, 0 AS pos, '20' AS size, n + 3 AS c FROM n WHERE face % 6 = 0
    UNION ALL SELECT face, 0, '16', n - low FROM n WHERE face % 6 = 1 UNION ALL SELECT face, 1, '22D', low FROM n WHERE face % 6 = 1
    UNION ALL SELECT face, 0, '22D', n - low FROM n WHERE face % 6 = 2 UNION ALL SELECT face, 1, '8 Twinax', low FROM n WHERE face % 6 = 2
    UNION ALL SELECT face, 0, '20', n // 3 FROM n WHERE face % 6 = 3 UNION ALL SELECT face, 1, '22D', n // 4 FROM n WHERE face % 6 = 3
    UNION ALL SELECT face, 2, '12', n - n // 3 - n // 4 FROM n WHERE face % 6 = 3
    UNION ALL SELECT face, i, [ '20', 'odd', 'odder' ][i + 1], n FROM n, range(3) r(i) WHERE face % 6 = 4),
  a AS (SELECT face, list(c ORDER BY {_ORDER}, pos) AS want, list(size ORDER BY {_ORDER}, pos) AS sizes,
          list(c ORDER BY {_ORDER}, pos DESC) AS down, list(size ORDER BY {_ORDER}, pos DESC) AS dsizes FROM t GROUP BY face),
  b AS (SELECT face, round(d, 2) AS bin, round(avg(d), 6) AS mean, count(*) AS n FROM l GROUP BY ALL),
  g AS (SELECT face, list(mean ORDER BY mean) AS means, list(n ORDER BY mean) AS ns, any_value(len(want)) AS k FROM b JOIN a USING (face) WHERE len(want) > 1 GROUP BY face),
  m AS (SELECT * FROM g UNION ALL
    SELECT face, list_concat(means[1:i - 1], [(means[i] * ns[i] + means[i + 1] * ns[i + 1]) / (ns[i] + ns[i + 1])], means[i + 2:]), list_concat(ns[1:i - 1], [ns[i] + ns[i + 1]], ns[i + 2:]), k
    FROM (SELECT *, list_position(gaps, list_min(gaps)) AS i FROM (SELECT *, list_transform(range(1, len(means)), lambda j: means[j + 1] - means[j]) AS gaps FROM m WHERE len(means) > k))),
  h AS (SELECT face, ns AS have FROM m WHERE len(means) <= k),
  w AS (SELECT n.face, n.n, want, sizes, down, dsizes, have, CASE WHEN want IS NULL THEN 'none' WHEN len(want) = 1 THEN 'single' WHEN want = have THEN 'bins'
          WHEN list_sort(want) = list_sort(have) THEN 'counts' WHEN list_sum(want) = n.n THEN 'ranked' ELSE 'ambiguous' END AS how
        FROM n LEFT JOIN a USING (face) LEFT JOIN h USING (face)),
  x AS (SELECT face, how, CASE how WHEN 'single' THEN [n] WHEN 'bins' THEN want WHEN 'counts' THEN have WHEN 'ranked' THEN down END AS c,
          CASE how WHEN 'single' THEN sizes WHEN 'bins' THEN sizes WHEN 'ranked' THEN dsizes WHEN 'counts' THEN
            list_transform(range(1, len(have) + 1), lambda i: list_filter(sizes, lambda s, q: want[q] = have[i])[1 + len(list_filter(have[1:i - 1], lambda y: y = have[i]))]) END AS z FROM w),
  v AS (SELECT face, how, unnest(z) AS size, unnest(list_transform(range(1, len(c) + 1), lambda i: coalesce(list_sum(c[1:i - 1]), 0))) AS before, unnest(c) AS c FROM x WHERE c IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY d, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rank FROM l)
  SELECT k.face, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, v.size, x.how FROM k JOIN x ON x.face = k.face LEFT JOIN v ON v.face = k.face AND rank > before AND rank <= before + v.c
""")
def contact_sizes(spark, sf_dir):
    """Sizes of contacts by the counts in a title: cumulative counts meet ranks by diameter in a join of cells."""
    out = faces.assign_sizes(*sized_points(spark, sf_dir), "face")
    return out.select("face", "id.l_orderkey", "id.l_linenumber", "id.l_suppkey", "id.l_extendedprice", "size", "how")


_LABEL = """CASE event_id % 11 WHEN 0 THEN '?' WHEN 1 THEN repeat(upper(left(event_type, 1)), (event_id % 5 + 2)::INT) WHEN 2 THEN 'ab' WHEN 3 THEN NULL ELSE upper(left(event_type, 1)) END"""


@query(f"""
  WITH e AS (SELECT event_id, user_id, {_LABEL} AS label FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY event_id) AS k FROM e),
  g AS (SELECT user_id, label, count(*) AS m FROM e WHERE regexp_full_match(label, '[A-Z]') GROUP BY ALL),
  t AS (SELECT DISTINCT user_id, left(label, 1) AS letter, length(label) AS n FROM e WHERE length(label) > 1 AND label = repeat(left(label, 1), length(label)::INT) AND regexp_full_match(label, '[A-Z]+')),
  f AS (SELECT g.user_id, g.label, n, row_number() OVER (PARTITION BY g.user_id, g.label ORDER BY n) AS i
        FROM (SELECT g.user_id, g.label, unnest(range(2, m + 10)) AS n FROM g) g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = g.user_id AND t.letter = g.label AND t.n = g.n))
  SELECT event_id, k.user_id, k.label, CASE WHEN f.n IS NOT NULL THEN repeat(k.label, f.n::INT) ELSE k.label END AS unique,
    CASE WHEN k.label IS NULL OR k.label = '?' THEN NULL WHEN k.k = 1 THEN 'first' WHEN regexp_full_match(k.label, '[A-Z]') THEN 'renamed' ELSE 'ambiguous' END AS status
  FROM k LEFT JOIN f ON f.user_id = k.user_id AND f.label = k.label AND f.i = k.k - 1 AND k.k > 1
""")
def unique_labels(spark, sf_dir):
    """Labels made unique inside a user: free names are counted, no row waits for the one before."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_LABEL.replace("::INT", "")).alias("label"))
    return faces.unique_labels(e, "user_id", "label", ["event_id"])


_BOX = "vec_id AS id, label, embedding[1]::DOUBLE * 10 AS x0, embedding[2]::DOUBLE * 10 AS y0, (embedding[1]::DOUBLE + abs(embedding[3]::DOUBLE)) * 10 AS x1, (embedding[2]::DOUBLE + abs(embedding[4]::DOUBLE)) * 10 AS y1"


@query(f"""
  WITH b AS (SELECT {_BOX} FROM embeddings)
  SELECT a.label, a.id AS a, b.id AS b FROM b a JOIN b ON b.label = a.label AND a.id % 2 = 0 AND b.id % 2 = 1 WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < a.x1 AND a.y0 < a.y1 AND b.x0 < b.x1 AND b.y0 < b.y1
""")
def box_overlaps(spark, sf_dir):
    """Boxes that share an area, dealt to tiles; tiles are split in four, as a label may hold many boxes in one place."""
    x, y, w, h = _at(1), _at(2), F.abs(_at(3)), F.abs(_at(4))
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", (x * 10).alias("x0"), (y * 10).alias("y0"), ((x + w) * 10).alias("x1"), ((y + h) * 10).alias("y1"))
    return ranges.overlapping(b.where("id % 2 = 0"), b.where("id % 2 = 1"), "label", 1.0, salt=4)
