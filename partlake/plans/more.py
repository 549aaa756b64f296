"""Further queries: selection, lookups, reports, unpivots and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions import math as M
from partlake.operators import catalog, corpus, decode, ranges, selection, validate
from partlake.plans.queries import _LIST, _MATES, _STATUS, ORACLE, PARSED, _status, current_capacity, distinct_parsed, query, table
from partlake.sources.feed import FEED, part_feed

_STOCK = "SELECT p_size AS part, count(*) % 11 AS h0, sum(p_partkey) % 7 AS h1, count(DISTINCT p_brand) % 5 AS h2, count(DISTINCT p_type) % 4 AS h3 FROM part GROUP BY p_size"
_NEED = """SELECT l_suppkey AS need, count(*) FILTER (WHERE l_quantity <= 5)::BIGINT % 6 AS n0, count(*) FILTER (WHERE l_quantity > 5 AND l_quantity <= 8)::BIGINT % 4 AS n1,
  count(*) FILTER (WHERE l_quantity > 8 AND l_quantity <= 13)::BIGINT % 4 AS n2, count(*) FILTER (WHERE l_quantity > 13 AND l_quantity <= 16)::BIGINT % 3 AS n3 FROM lineitem GROUP BY l_suppkey"""


def _fit_sql() -> str:
    steps = ["f0 AS (SELECT *, true AS ok0, 0 AS u0, h0::BIGINT AS r0_0, h1::BIGINT AS r0_1, h2::BIGINT AS r0_2, h3::BIGINT AS r0_3 FROM need CROSS JOIN stock)"]
    for i in range(4):
        at = "CASE WHEN n{0} = 0 THEN {0} ".format(i) + " ".join(f"WHEN r{i}_{j} >= n{i} THEN {j}" for j in range(i, 4)) + " ELSE -1 END"
        after = ", ".join(f"CASE WHEN ({at}) = {j} THEN r{i}_{j} - n{i} ELSE r{i}_{j} END AS r{i + 1}_{j}" for j in range(4))
        steps.append(f"f{i + 1} AS (SELECT *, ok{i} AND ({at}) >= 0 AS ok{i + 1}, u{i} + CASE WHEN ({at}) > {i} THEN 1 ELSE 0 END AS u{i + 1}, {after} FROM f{i})")
    return f"""
  WITH stock AS ({_STOCK}), need AS ({_NEED}), {", ".join(steps)},
  k AS (SELECT need, part, u4 AS upsizes, r4_0 + r4_1 + r4_2 + r4_3 AS spare FROM f4 WHERE ok4)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY need ORDER BY upsizes, spare DESC, part) AS place FROM k) WHERE place <= 5"""


@query(_fit_sql())
def suggest_arrangement(spark, sf_dir):
    """Each need against the arrangements with as many contacts in all."""
    stock = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("part")).agg(
        (F.count("*") % 11).alias("h0"), (F.sum("p_partkey") % 7).alias("h1"), (F.count_distinct("p_brand") % 5).alias("h2"), (F.count_distinct("p_type") % 4).alias("h3")
    )
    q = F.col("l_quantity")
    bands = [(None, 5, 6), (5, 8, 4), (8, 13, 4), (13, 16, 3)]
    counts = [(F.count_if((q <= hi) if lo is None else (q > lo) & (q <= hi)) % m).alias(f"n{i}") for i, (lo, hi, m) in enumerate(bands)]
    need = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("need")).agg(*counts)
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(4)), F.lit(1)).alias(f"total_{c}")  # noqa: E731  (one more each, as nothing is a need, too)
    pairs = ranges.at_least(need.select("*", total("n")), stock.select("*", total("h")), "total_n", "total_h").drop("total_n", "total_h")
    fitted = selection.fit_sizes(pairs, ["n0", "n1", "n2", "n3"], ["h0", "h1", "h2", "h3"])
    return selection.best_fits(fitted, "need", "part", 5).select("need", "part", "upsizes", "spare", "place")


_NOTES = "concat(p_size % 9 + 1, ' #22D, ', p_partkey % 4 + 1, ' x #8 Coax, 2 #', CASE WHEN p_size % 2 = 0 THEN '16' ELSE '8 Twinax' END)"


@query(rf"""
  WITH n AS (SELECT p_partkey, {_NOTES} AS note FROM part),
  x AS (SELECT p_partkey, regexp_extract_all(note, '(\d+)\s*x?\s*#\s*(\d+D?(?: Coax| Twinax)?)', 1) AS c, regexp_extract_all(note, '(\d+)\s*x?\s*#\s*(\d+D?(?: Coax| Twinax)?)', 2) AS s FROM n),
  u AS (SELECT p_partkey, unnest(c)::INT AS count, unnest(s) AS size FROM x)
  SELECT *, CASE WHEN contains(size, 'Coax') THEN 'coax' WHEN contains(size, 'Twinax') THEN 'twinax' ELSE 'signal' END AS kind FROM u
""")
def contact_notes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_NOTES).alias("note"))
    rows = p.select("p_partkey", F.explode(selection.contact_notes("note")).alias("x")).select("p_partkey", "x.count", "x.size")
    return rows.withColumn("kind", selection.contact_type(F.col("size")))


@query(f"SELECT id, n_signal, amps FROM ({ORACLE['current_capacity']}) WHERE n_signal BETWEEN 5 AND 20 AND amps >= 50 ORDER BY amps DESC, id LIMIT 20")
def search_arrangements(spark, sf_dir):
    c = current_capacity(spark, sf_dir).where("n_signal BETWEEN 5 AND 20 AND amps >= 50")
    return c.orderBy(F.desc("amps"), "id").limit(20).select("id", "n_signal", "amps")


_FIELDS = ["series", "sheet", "class", "size", "insert", "contact", "key"]


@query(f"WITH {PARSED}, d AS (SELECT DISTINCT normalized, " + ", ".join(f'"{f}"' for f in _FIELDS) + " FROM parsed WHERE error IS NULL) " + " UNION ALL ".join(f"""SELECT normalized, '{f}' AS field, "{f}" AS value FROM d""" for f in _FIELDS))
def decoded_fields(spark, sf_dir):
    """Unpivot: one row a part of each number."""
    d = distinct_parsed(spark, sf_dir).where("error IS NULL").select("normalized", *_FIELDS).distinct()
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in _FIELDS])
    return d.select("normalized", F.explode(pairs).alias("p")).select("normalized", "p.field", "p.value")


_RULES = f"rule(ord, vendor, line, fmt, rule_series, base, sizes, contacts, keys, rule_sheet, rule_class, style, finish) AS (VALUES {R.values(R.rule_rows())})"


@query(f"WITH {_RULES} SELECT ord, style, finish, string_agg(rule_sheet || ':' || rule_class, ',' ORDER BY rule_sheet, rule_class) AS members, count(*) AS n FROM rule WHERE fmt NOT IN ('letter', 'ACT') GROUP BY ord, style, finish HAVING count(*) > 1")
def lossy_codes(spark, sf_dir):
    """Vendor codes that more than one sheet and class share, so that the way back is not unique."""
    r = spark.createDataFrame(R.rule_rows(), R.RULE_SCHEMA).where("fmt NOT IN ('letter', 'ACT')")
    names = F.array_sort(F.collect_list(F.concat("rule_sheet", F.lit(":"), "rule_class")))
    return r.groupBy("ord", "style", "finish").agg(F.array_join(names, ",").alias("members"), F.count("*").alias("n")).where("n > 1")


@query(f"WITH {_RULES} SELECT vendor, rule_series AS series, count(DISTINCT ord) AS n_rules, count(*) AS n_codes, count(DISTINCT rule_sheet) AS n_sheets, count(DISTINCT rule_class) AS n_classes FROM rule GROUP BY ALL")
def rule_summary(spark, sf_dir):
    r = spark.createDataFrame(R.rule_rows(), R.RULE_SCHEMA)
    return r.groupBy("vendor", F.col("rule_series").alias("series")).agg(
        F.count_distinct("ord").alias("n_rules"), F.count("*").alias("n_codes"), F.count_distinct("rule_sheet").alias("n_sheets"), F.count_distinct("rule_class").alias("n_classes")
    )


@query(f"""
  WITH {PARSED}, {_STATUS}, {_MATES}
  SELECT normalized, CASE WHEN mate IS NULL THEN 'NO_MATE' ELSE mate_pn END AS entry, n FROM (
    SELECT s.normalized, mt.mate, mt.mate_pn, count(*) AS n FROM (SELECT * FROM st WHERE error IS NULL) s LEFT JOIN mt ON s.raw_pn = mt.raw_pn GROUP BY ALL)
""")
def cross_reference_report(spark, sf_dir):
    """Each number with its mates, and one placeholder row where there is none."""
    s = _status(spark, sf_dir).where("error IS NULL")
    m = validate.mates(s).select(F.col("raw_pn").alias("r"), "mate", "mate_pn")
    j = s.join(m, s["raw_pn"] == m["r"], "left")
    counted = j.groupBy("normalized", "mate", "mate_pn").agg(F.count("*").alias("n"))
    return counted.select("normalized", F.when(F.col("mate").isNull(), "NO_MATE").otherwise(F.col("mate_pn")).alias("entry"), "n")


@query(rf"""
  WITH feed AS ({FEED}), q AS (SELECT raw_pn AS text FROM feed UNION ALL SELECT (p_size || '-' || (p_partkey % 61 + 1)) FROM part)
  SELECT CASE WHEN regexp_matches(upper(trim(text)), '^\d{{1,2}}-\d{{1,3}}$') THEN 'arrangement'
              WHEN regexp_matches(upper(trim(text)), '^(D38999)?/?\d{{2}}[A-Z]') THEN 'part number' ELSE 'vendor number' END AS kind, count(*) AS n FROM q GROUP BY ALL
""")
def search_router(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_size", F.col("p_partkey") % 61 + 1).alias("text"))
    q = part_feed(spark, sf_dir).select(F.col("raw_pn").alias("text")).unionByName(ids)
    return q.groupBy(catalog.query_kind("text").alias("kind")).agg(F.count("*").alias("n"))


@query("""
  SELECT p_partkey, round(p_size + (p_partkey % 60) / 60.0, 4)::DOUBLE AS degrees, least(greatest(p_size, 10), 40)::INT AS clamped,
    greatest(2, floor(p_size * 15 / 100))::BIGINT AS spare, round(100.0 + p_size * cos(radians(p_partkey % 360)), 6)::DOUBLE AS x,
    round(200.0 + p_size * sin(radians(p_partkey % 360)), 6)::DOUBLE AS y, (2 * 50 - p_size)::INT AS mirrored FROM part
""")
def math_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, y = M.polar(F.lit(100.0), F.lit(200.0), F.col("p_size"), F.col("p_partkey") % 360)
    return p.select(
        "p_partkey",
        M.dms_to_degrees(F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double")).alias("degrees"),
        M.clamp(F.col("p_size"), 10, 40).alias("clamped"),
        M.spare_target(F.col("p_size"), F.lit(15)).alias("spare"),
        F.round(x, 6).alias("x"),
        F.round(y, 6).alias("y"),
        M.mirror_x(F.col("p_size"), F.lit(50)).alias("mirrored"),
    )


_KNOWN = [str(i) for i in range(1, 40)]
_A, _B = r"^D38999/(\d\d)(AA|AB|[A-Z])([A-HJ])(\d{1,3})([A-Z])([A-Z])$", r"^D38999/(\d\d)(AA|AB|[A-Z])([A-HJ])(\d{1,3})([A-Z])$"


@query(rf"""
  WITH feed AS ({FEED}), d AS (SELECT DISTINCT raw_pn, regexp_replace(upper(raw_pn), '[\s-]', '', 'g') AS pn FROM feed),
  s AS (SELECT raw_pn,
    CASE WHEN regexp_matches(pn, '{_A}') THEN CASE WHEN regexp_extract(pn, '{_A}', 4) IN ({_LIST(_KNOWN)}) THEN 12 ELSE 2 END END AS a,
    CASE WHEN regexp_matches(pn, '{_B}') THEN CASE WHEN regexp_extract(pn, '{_B}', 4) IN ({_LIST(_KNOWN)}) THEN 11 ELSE 1 END END AS b, pn FROM d)
  SELECT raw_pn, CASE WHEN a IS NOT NULL AND (b IS NULL OR b <= a) THEN pn WHEN b IS NOT NULL THEN pn || 'N' END AS pin,
    CASE WHEN a IS NOT NULL AND (b IS NULL OR b <= a) THEN true WHEN b IS NOT NULL THEN false END AS key_given,
    CASE WHEN a IS NOT NULL AND (b IS NULL OR b <= a) THEN a ELSE b END AS score FROM s
""")
def pn_decode_scored(spark, sf_dir):
    return decode.decode_scored(part_feed(spark, sf_dir).select("raw_pn").distinct(), "raw_pn", _KNOWN)


@query("SELECT p_partkey, p_name FROM part ORDER BY md5(concat('7:', p_partkey)), p_partkey LIMIT 50")
def seeded_sample(spark, sf_dir):
    """The same sample without replacement on every run: the smallest seeded hashes."""
    p = table(spark, sf_dir, "part")
    return p.orderBy(F.md5(F.concat(F.lit("7:"), "p_partkey").cast("binary")), "p_partkey").limit(50).select("p_partkey", "p_name")


@query("""
  WITH k AS (SELECT p_partkey AS pos, lower(regexp_replace(regexp_replace(trim(t), '[_\\s]+', ' ', 'g'), '\\s*([/-])\\s*', '\\1', 'g')) AS key, t AS label FROM (
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN p_name ELSE upper(substr(p_name, 1, 1)) || substr(p_name, 2) END AS t FROM part)),
  s AS (SELECT *, least(length(label), 48) + 100 + CASE WHEN contains(label, '_') THEN 0 ELSE 300 END + CASE WHEN regexp_matches(label, '[a-z]') AND regexp_matches(label, '[A-Z]') THEN 200 ELSE 0 END
     + CASE WHEN label <> upper(label) THEN 200 ELSE 0 END + CASE WHEN regexp_matches(label, '[/-]') THEN 100 ELSE 0 END AS score FROM k)
  SELECT key, min(pos) AS first_pos, arg_max(label, (score, -pos)) AS label, count(*) AS n FROM s GROUP BY key
""")
def dedupe_display(spark, sf_dir):
    """Labels equal but for form: the place of the first, the text of the most presentable."""
    from partlake.functions import text as X

    n = F.col("p_name")
    label = (
        F.when(F.col("p_partkey") % 4 == 0, F.upper(n))
        .when(F.col("p_partkey") % 4 == 1, F.replace(n, F.lit(" "), F.lit("_")))
        .when(F.col("p_partkey") % 4 == 2, n)
        .otherwise(F.concat(F.upper(F.substring(n, 1, 1)), F.expr("substring(p_name, 2)")))
    )
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), label.alias("label"))
    k = k.withColumn("key", X.display_key("label")).withColumn("score", X.display_score("label"))
    return k.groupBy("key").agg(
        F.min("pos").alias("first_pos"), F.max_by("label", F.struct("score", -F.col("pos"))).alias("label"), F.count("*").alias("n")
    )


@query("""
  WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT s_suppkey * 2 AS k FROM supplier)
  SELECT coalesce(a.k, b.k) AS number, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
""")
def symmetric_difference(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("number"))
    return corpus.snapshot_diff(a, b, "number").where("change <> 'kept'").withColumnRenamed("change", "side")


@query(f"""
  WITH {PARSED}, con(contact, meaning) AS (VALUES {R.values(R.CONTACTS)}), she(sheet, description) AS (VALUES {R.values(R.SHEET_DESCRIPTIONS)})
  SELECT sheet, description, contact, coalesce(meaning, 'not defined') AS meaning, count(*) AS n FROM parsed LEFT JOIN con USING (contact) LEFT JOIN she USING (sheet) WHERE error IS NULL GROUP BY ALL
""")
def definition_lookup(spark, sf_dir):
    """Codes with their definitions; unknown codes say so."""
    c = F.broadcast(spark.createDataFrame(R.CONTACTS, "contact string, meaning string"))  # fixed rows
    s = F.broadcast(spark.createDataFrame(R.SHEET_DESCRIPTIONS, "sheet string, description string"))  # fixed rows
    p = distinct_parsed(spark, sf_dir).where("error IS NULL").groupBy("sheet", "contact").agg(F.sum("n_lines").alias("n"))
    return p.join(c, "contact", "left").join(s, "sheet", "left").select("sheet", "description", "contact", F.coalesce("meaning", F.lit("not defined")).alias("meaning"), "n")

