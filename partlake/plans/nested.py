"""Queries on nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators import convert, nested
from partlake.plans.labels import pick, pick_sql
from partlake.plans.queries import _RATE, query, table

_SIZES = ["22D", "20", "8 Coax", "16", "8 Twinax", "12", "20 HD", "99"]


def arrangements(spark, sf_dir) -> DataFrame:
    """Arrangements from parts: none to three notes each."""
    k, s = F.col("p_partkey"), F.col("p_size")
    note = lambda i: F.struct((s % 7 + i).cast("int").alias("count"), pick(_SIZES, (k + 3 * i) % 8).alias("size"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.slice(F.array(note(0), note(1), note(2)), F.lit(1), (k % 4).cast("int")).alias("notes"))


_AMP = "CASE WHEN size IN ('22D', '20', '16', '12') THEN " + _RATE + " WHEN size = '20 HD' THEN 7.5 END"
_NOTES = f"""
  i AS (SELECT p_partkey AS id, p_size, unnest(range(p_partkey % 4)) AS i FROM part),
  n AS (SELECT id, i, p_size % 7 + i AS count, {pick_sql(_SIZES, "(id + 3 * i) % 8")} AS size FROM i),
  a AS (SELECT *, {_AMP}::DOUBLE AS amps FROM n)
"""


@query(f"""
  WITH {_NOTES}, g AS (SELECT id, string_agg(count || 'x #' || size, ', ' ORDER BY i) AS sizes, max(amps) AS best,
      string_agg('#' || size || ' = ' || regexp_replace(amps::VARCHAR, '\\.0$', '') || ' A', ', ' ORDER BY amps DESC, i) FILTER (WHERE amps IS NOT NULL) AS rated FROM a GROUP BY id)
  SELECT p_partkey AS id, coalesce(sizes, 'unknown') AS sizes, coalesce(best, 0.0)::DOUBLE AS best, coalesce(best, 0) >= 13 AS meets_13,
    CASE WHEN rated IS NULL THEN 'RF / data contacts only (no power rating)' ELSE 'up to ' || regexp_replace(best::VARCHAR, '\\.0$', '') || ' A/contact (' || rated || ')' END AS summary
  FROM part LEFT JOIN g ON id = p_partkey
""")
def arrangement_currents(spark, sf_dir):
    a = arrangements(spark, sf_dir)
    return a.select(
        "id", nested.size_summary("notes").alias("sizes"), nested.max_amps("notes").alias("best"), nested.meets_current("notes", 13.0).alias("meets_13"),
        nested.current_summary("notes").alias("summary"),
    )


@query(f"WITH {_NOTES} SELECT DISTINCT amps FROM a WHERE amps > 0 ORDER BY amps")
def current_thresholds(spark, sf_dir):
    return nested.thresholds(arrangements(spark, sf_dir), "notes")


_LABELS = ["A", "B", "?", "A", "C"]


@query(f"""
  WITH c AS (SELECT p_partkey AS id, unnest(range(4)) AS i, p_size FROM part),
  l AS (SELECT id, i + 1 AS position, {pick_sql(_LABELS, "(id * (i + 1) + p_size) % 5")} AS label FROM c),
  n AS (SELECT *, count(*) OVER (PARTITION BY id, label) AS n FROM l)
  SELECT id, position::INT AS position, label, CASE WHEN label = '?' THEN '#' || position WHEN n > 1 THEN label || '__' || position ELSE label END AS key FROM n
""")
def contact_list(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    labels = F.array(*[pick(_LABELS, (k * (i + 1) + s) % 5) for i in range(4)])
    return nested.flatten_contacts(table(spark, sf_dir, "part").select(k.alias("id"), labels.alias("labels")), "id", "labels")


@query("""
  WITH p AS (SELECT p_partkey AS id, p_brand AS b, p_size AS s FROM part)
  SELECT id, array_to_string(list_filter(CASE id % 4
      WHEN 0 THEN [b, 'QPL ' || s, 'cite ' || b] WHEN 1 THEN [b, 'QPL ' || s, 'a.pdf page ' || s] WHEN 2 THEN [b, 'QPL ' || s, 'secondary index'] ELSE [b, 'QPL ' || s] END, lambda x: x IS NOT NULL), ' | ') AS bits,
    array_to_string(CASE WHEN id % 3 = 0 THEN ['v' || id, 'w' || id] ELSE ['w' || id, 'e1', 'e2'] END, ',') AS parts,
    CASE WHEN id % 3 = 0 THEN '' ELSE 'wide' END AS first_text,
    CASE WHEN id % 2 = 0 THEN 'a,b' ELSE 'a,b,' || b END AS appended
  FROM p
""")
def sources_and_examples(spark, sf_dir):
    k, s, b = F.col("p_partkey"), F.col("p_size"), F.col("p_brand")
    kind = pick(["verified", "example", "secondary", "list"], k % 4)
    source = F.struct(kind.alias("kind"), F.concat(F.lit("cite "), b).alias("citation"), F.lit("a.pdf").alias("pdf"), s.alias("page"), s.cast("string").alias("list"))
    part = lambda x, d: F.struct(F.concat(F.lit(x), k.cast("string")).alias("pn"), F.lit(d).alias("description"))
    plain = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("w"), k.cast("string")), F.lit("e1"), F.lit("e2"), F.lit("e3")))
    examples = nested.example_parts(plain, F.array(part("v", None), part("w", "wide")))
    appended = nested.append_unique(F.array(F.lit("a"), F.lit("b")), F.when(k % 2 == 0, F.lit("b")).otherwise(b))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.array_join(nested.source_bits(F.array(b), F.array(s.cast("string")), F.array(source)), " | ").alias("bits"),
        F.array_join(F.transform(examples, lambda x: x["pn"]), ",").alias("parts"), F.get(examples, F.lit(0))["description"].alias("first_text"),
        F.array_join(appended, ",").alias("appended"),
    )


@query(r"""
  WITH t AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\r?\n|;|\t'), lambda x: trim(x)), lambda x: x <> '')) AS entry FROM documents)
  SELECT doc_id, count(*) AS n, min(entry) AS least, max(length(entry))::INT AS longest FROM t GROUP BY doc_id
""")
def batch_entries(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", F.explode(nested.split_batch("text")).alias("entry"))
    return e.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("entry").alias("least"), F.max(F.char_length("entry")).alias("longest"))


@query("""
  SELECT event_id, '{"a":"' || (event_id % 3) || '","k":"' || (event_id % 7) || '"}' AS canonical,
    CASE WHEN event_id % 2 = 0 THEN '{"id":' || event_id || ',"kind":"' || event_type || '"}' ELSE '{"id":' || event_id || '}' END AS compact FROM events
""")
def json_forms(spark, sf_dir):
    i = F.col("event_id")
    text = F.concat(F.lit('{ "k" : '), (i % 7).cast("string"), F.lit(', "a":'), (i % 3).cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select(
        "event_id", nested.canonical_json(text).alias("canonical"), nested.compact_record(id=i, kind=F.when(i % 2 == 0, F.col("event_type"))).alias("compact")
    )


@query("""
  WITH s AS (SELECT s_suppkey AS id, unnest([0, 1, 2]) AS i FROM supplier), f AS (SELECT *, unnest([1, 2]) AS j FROM s)
  SELECT id, ['standard', 'rugged', 'accessory'][i + 1] AS section, 'f' || (id % 5) || j AS family, 'p' || id || i || j AS pn FROM f WHERE (id + i + j) % 3 > 0
""")
def nested_parts(spark, sf_dir):
    k = F.col("s_suppkey")

    def family(i: int, j: int) -> Column:
        part = F.struct(F.concat(F.lit("p"), k.cast("string"), F.lit(f"{i}{j}")).alias("pn"), ((k + i + j) % 3 > 0).alias("verified"))
        return F.struct(F.concat(F.lit("f"), (k % 5).cast("string"), F.lit(str(j))).alias("family"), F.array(part).alias("parts"))

    doc = F.to_json(F.struct(*[F.array(family(i, 1), family(i, 2)).alias(s) for i, s in enumerate(nested.SECTIONS)]))
    return nested.collect_parts(table(spark, sf_dir, "supplier").select(k.alias("id"), doc.alias("doc")), "id", "doc")


@query(f"""
  WITH r(o, c, z) AS (VALUES {R.values([(r[0], "".join(sorted(r[10], key=lambda c: (len(c), c))), r[6] or "ABCDEFGHJ") for r in R.RULES])})
  SELECT o AS ord, array_to_string(list_sort(regexp_extract_all(c, '.')), ',') AS classes, z AS sizes FROM r
""")
def rule_domains(spark, sf_dir):
    return nested.rule_classes(convert.rules(spark)).select("ord", F.array_join("classes", ",").alias("classes"), "sizes")
