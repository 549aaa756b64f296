"""Queries on conversion of any number, checks between tables, and lookups with alternatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators import consistency, convert, dispatch, grounding, lookups, rugged
from partlake.plans.labels import pick, pick_sql
from partlake.plans.queries import _LIST, FORWARD, PARSED, convert_forward, distinct_parsed, query, table
from partlake.sources.feed import part_feed


# --- any number ---------------------------------------------------------------------------
def mixed_numbers(spark, sf_dir):
    raw = part_feed(spark, sf_dir).select(F.col("raw_pn").alias("number"))
    vendor = convert_forward(spark, sf_dir).select(F.col("vendor_pn").alias("number"))
    family = table(spark, sf_dir, "part").select(F.concat(F.lit("RJF-"), (F.col("p_partkey") % 50).cast("string")).alias("number"))
    return raw.union(vendor).union(family).distinct()


_RUGGED = "regexp_matches(upper(number), '^(" + "|".join(p for _, p, _, _ in rugged.FAMILIES) + ")')"
_ANY = f"""
  WITH {PARSED}, {FORWARD}, v AS (SELECT DISTINCT vendor_pn FROM converted),
  p AS (SELECT raw_pn, any_value(error) AS error, any_value(normalized) AS normalized FROM parsed GROUP BY raw_pn),
  a AS (SELECT raw_pn AS number FROM p UNION SELECT vendor_pn FROM v UNION SELECT 'RJF-' || p_partkey % 50 FROM part),
  md AS (SELECT number, CASE WHEN {_RUGGED} THEN 'rugged' WHEN p.raw_pn IS NOT NULL AND error IS NULL THEN 'standard' WHEN v.vendor_pn IS NOT NULL THEN 'vendor' ELSE 'error' END AS mode, normalized
        FROM a LEFT JOIN p ON raw_pn = number LEFT JOIN v ON vendor_pn = number)
"""


@query(_ANY + " SELECT mode, count(*) AS n, count(DISTINCT normalized) FILTER (WHERE mode = 'standard') AS n_standard FROM md GROUP BY mode")
def convert_modes(spark, sf_dir):
    out = dispatch.convert_any(mixed_numbers(spark, sf_dir), "number")
    return out.groupBy("mode").agg(F.count_distinct("number").alias("n"), F.count_distinct(F.when(F.col("mode") == "standard", F.col("normalized"))).alias("n_standard"))


@query(_ANY + " SELECT number, mode <> 'error' AS ok, CASE WHEN mode = 'standard' THEN normalized END AS own FROM md WHERE mode <> 'rugged'")
def batch_decode(spark, sf_dir):
    out = dispatch.batch_decode(mixed_numbers(spark, sf_dir), "number")
    return out.select("number", "ok", F.when(F.col("source") == "standard", F.col("normalized")).alias("own"))


@query(f"""
  WITH {PARSED}, {FORWARD}, k AS (SELECT DISTINCT vendor_pn, vendor, normalized FROM converted)
  SELECT vendor_pn, count(*) > 0 AS found FROM k GROUP BY vendor_pn
""")
def reverse_ranked(spark, sf_dir):
    """Every forward number has a first reading, and among its readings is where it came from."""
    fed = convert_forward(spark, sf_dir).select("vendor_pn", "vendor", "normalized").distinct()
    ranked = dispatch.ranked_reverse(fed.select("vendor_pn").distinct())
    met = fed.join(ranked, ["vendor_pn", "vendor", "normalized"], "left")
    first = ranked.groupBy("vendor_pn").agg(F.min("place").alias("least"))
    return met.groupBy("vendor_pn").agg(F.bool_and(F.col("place").isNotNull()).alias("all")).join(first, "vendor_pn").select("vendor_pn", (F.col("all") & (F.col("least") == 1)).alias("found"))


@query(f"""
  WITH {PARSED}, {FORWARD}, o AS (SELECT DISTINCT normalized, sheet, size_number FROM parsed WHERE error IS NULL),
  k AS (SELECT DISTINCT normalized, vendor, line, vendor_pn FROM converted), gv AS (SELECT normalized, string_agg(vendor || ' ' || vendor_pn, ', ' ORDER BY vendor, line, vendor_pn) AS vendors FROM k GROUP BY normalized)
  SELECT o.*, coalesce(CASE sheet {" ".join(f"WHEN '{s}' THEN '{d}'" for s, d in R.SHEET_DESCRIPTIONS)} END, sheet) AS description, coalesce(vendors, '') AS vendors FROM o LEFT JOIN gv USING (normalized)
""")
def connector_blocks(spark, sf_dir):
    out = dispatch.connector_blocks(distinct_parsed(spark, sf_dir))
    return out.withColumn("vendors", F.array_join(F.transform("vendors", lambda v: F.concat(v["vendor"], F.lit(" "), v["vendor_pn"])), ", "))


@query(f"WITH {PARSED}, {FORWARD}, k AS (SELECT DISTINCT ord, fmt, vendor_pn, normalized FROM converted) SELECT ord, fmt, count(*) AS n, count(*) AS n_fit FROM k GROUP BY ALL")
def layout_check(spark, sf_dir):
    """Numbers of each rule against a pattern written apart from the conversion."""
    parts = ["normalized", "error", "sheet", "class", "size", "size_number", "size_padded", "insert", "contact", "key"]
    out = convert.convert_forward(distinct_parsed(spark, sf_dir).where("error IS NULL").select(*parts).distinct()).withColumn("rule_class", F.col("class"))
    fits = F.rlike("vendor_pn", dispatch.layout_pattern())
    return out.groupBy("ord", "fmt").agg(F.count("*").alias("n"), F.count_if(fits).alias("n_fit"))


# --- checks between tables ----------------------------------------------------------------
@query("""
  WITH a AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
  n AS (SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS n_rows,
    (SELECT count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)) + (SELECT count(*) FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)) AS n_bad)
  SELECT 'orders and lines' AS "check", n_rows, n_bad, CASE WHEN n_bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n
""")
def dq_parity(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return consistency.parity(a, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct(), "orders and lines")


@query("""
  WITH s AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 10 <> 3), m AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 4)
  SELECT p_partkey, 'missing' AS field FROM s ANTI JOIN m USING (p_partkey) UNION ALL SELECT p_partkey, 'extra' FROM m ANTI JOIN s USING (p_partkey)
  UNION ALL SELECT p_partkey, 'p_size' FROM s JOIN m USING (p_partkey) WHERE s.p_size <> m.p_size
""")
def dq_drift(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    made = p.where("p_partkey % 10 <> 4").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return consistency.drift(p.where("p_partkey % 10 <> 3"), made, "p_partkey", ["p_brand", "p_size"])


_RULE_ROWS = R.values([(r[0], r[9], r[10], r[7], r[8]) for r in R.rule_rows()])


@query(f"""
  WITH r(ord, sheet, cls, contacts, keys) AS (VALUES {_RULE_ROWS}),
  c AS (SELECT 'rule sheets' AS "check", count(*) AS n_rows, count(*) FILTER (WHERE sheet NOT IN ({_LIST(R.SERIES_III + R.SERIES_IV)})) AS n_bad FROM r
    UNION ALL SELECT 'rule classes', count(*), count(*) FILTER (WHERE cls NOT IN ({_LIST(R.CLASSES)})) FROM r
    UNION ALL SELECT 'rule contacts', count(*), count(*) FILTER (WHERE NOT regexp_full_match(contacts, '[{R.KNOWN_CONTACT_LETTERS}]*')) FROM r
    UNION ALL SELECT 'rule keys', count(*), count(*) FILTER (WHERE NOT regexp_full_match(keys, '[{R.KEYS_IV}E]*')) FROM r
    UNION ALL SELECT 'gauge order', {len(R.RATINGS)}, {sum(a > b for _, _, a, b in R.RATINGS)})
  SELECT *, CASE WHEN n_bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c
""")
def dq_rules(spark, sf_dir):
    rules = convert.rules(spark)
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "v string")
    gauges = spark.createDataFrame(R.RATINGS, "size string, amps double, low int, high int")
    parts = [
        consistency.in_domain(rules, "rule_sheet", one(R.SERIES_III + R.SERIES_IV), "rule sheets"), consistency.in_domain(rules, "rule_class", one(R.CLASSES), "rule classes"),
        consistency.letters_in(rules, "contacts", R.KNOWN_CONTACT_LETTERS, "rule contacts"), consistency.letters_in(rules, "keys", R.KEYS_IV + "E", "rule keys"),
        consistency.ordered(gauges, "low", "high", "gauge order"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
  WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
  SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS listed, b.k IS NOT NULL AS found FROM a FULL JOIN b ON a.k = b.k
""")
def inventory(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return consistency.inventory(a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query(f"""
  WITH {PARSED}, {FORWARD}, r(ord) AS (SELECT DISTINCT ord FROM rule) SELECT ord FROM r WHERE ord NOT IN (SELECT ord FROM converted WHERE "insert" = '35')
""")
def rules_without_golden(spark, sf_dir):
    """Rules that no number with insert 35 proves."""
    parts = ["normalized", "error", "sheet", "class", "size", "size_number", "size_padded", "insert", "contact", "key"]
    proven = convert.convert_forward(distinct_parsed(spark, sf_dir).where("error IS NULL AND `insert` = '35'").select(*parts).distinct())
    return consistency.only_in(convert.rules(spark), proven, "ord")


@query(f"""
  WITH {PARSED}, d AS (SELECT DISTINCT normalized, sheet, class, contact FROM parsed WHERE error IS NULL),
  cb(sheet, cls, letters) AS (VALUES {R.values([(r[9], r[10], r[7]) for r in R.rule_rows()])})
  SELECT d.normalized, coalesce(bool_or(cls = class AND contains(letters, contact)), false) AS honoured FROM d LEFT JOIN cb USING (sheet) GROUP BY d.normalized
""")
def combos_honoured(spark, sf_dir):
    d = distinct_parsed(spark, sf_dir).where("error IS NULL").select("normalized", "sheet", "class", "contact").distinct()
    combos = convert.rules(spark).select(F.col("rule_sheet").alias("sheet"), F.col("rule_class").alias("cls"), F.col("contacts").alias("letters"))
    test = (F.col("cls") == F.col("class")) & F.expr("instr(letters, contact) > 0")
    return consistency.honours_any(d, F.broadcast(combos), "sheet", "normalized", test)  # some two hundred fixed rows


@query("""
  WITH s AS (SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL)
  SELECT s.source, s.lang, count(d.doc_id) FILTER (WHERE contains(d.text, s.lang)) AS n_texts FROM s LEFT JOIN documents d ON d.source = s.source GROUP BY s.source, s.lang
""")
def texts_grounded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    signs = docs.where("lang IS NOT NULL").select("source", "lang").distinct()
    return grounding.grounded(signs, docs, "source", "lang", "text")


# --- lookups ------------------------------------------------------------------------------
def catalog_rows(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    letters = lambda n, xs: F.when(n, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(x) for x in xs]))
    return table(spark, sf_dir, "part").select(
        k.alias("row_id"), pick(["20", "24", "26", "XX"], k % 4).alias("style"), F.when(s % 3 == 0, pick(["26", "20", "40"], k % 3)).alias("equivalent"),
        letters(s % 2 == 0, "PS").alias("contacts"), letters(s % 5 == 0, "NAB").alias("keys"), F.col("p_brand").alias("source"),
    )


_SUPPORT = f"""
  WITH {PARSED}, d AS (SELECT DISTINCT normalized, sheet, contact, key FROM parsed WHERE error IS NULL),
  ct AS (SELECT p_partkey AS row_id, {pick_sql(["20", "24", "26", "XX"], "p_partkey % 4")} AS style, CASE WHEN p_size % 3 = 0 THEN {pick_sql(["26", "20", "40"], "p_partkey % 3")} END AS equivalent,
      CASE WHEN p_size % 2 = 0 THEN '' ELSE 'PS' END AS contacts, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'NAB' END AS keys, p_brand AS source FROM part),
  mt AS (SELECT * FROM d JOIN ct ON (sheet = style OR sheet = equivalent) AND (contacts = '' OR contains(contacts, contact)) AND (keys = '' OR contains(keys, key)))
"""


@query(_SUPPORT + " SELECT d.normalized, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM d LEFT JOIN mt USING (normalized) GROUP BY d.normalized")
def supported_sources(spark, sf_dir):
    """Decoded numbers are grouped by what the catalog looks at first, so each different question is joined once."""
    d = distinct_parsed(spark, sf_dir).where("error IS NULL").select("normalized", "sheet", "contact", "key").distinct()
    asked = d.select(F.concat_ws("/", "sheet", "contact", "key").alias("q"), "sheet", "contact", "key").distinct()
    found = lookups.supported_sources(asked, catalog_rows(spark, sf_dir), "q")
    out = d.withColumn("q", F.concat_ws("/", "sheet", "contact", "key")).join(found, "q")
    return out.select("normalized", F.array_join("sources", ",").alias("sources"))


@query(f"""
  WITH t AS (SELECT p_partkey, {pick_sql([s for s, _ in R.SHEET_DESCRIPTIONS], "p_partkey % 17")} AS sheet, p_size % 3 = 0 AS draft, {pick_sql(["III", "IV", "II"], "p_size % 3")} AS series FROM part)
  SELECT sheet, arg_min(p_partkey, (draft, p_partkey)) AS best, arg_min(p_partkey, p_partkey) FILTER (WHERE NOT draft AND series IN ('III', 'IV')) AS approved, count(*) FILTER (WHERE draft) AS n_drafts FROM t GROUP BY sheet
""")
def document_precedence(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    t = table(spark, sf_dir, "part").select(k, pick([x for x, _ in R.SHEET_DESCRIPTIONS], k % 17).alias("sheet"), (s % 3 == 0).alias("draft"), pick(["III", "IV", "II"], s % 3).alias("series"))
    best = lookups.prefer(t, "sheet", ["draft", "p_partkey"]).select("sheet", F.col("p_partkey").alias("best"))
    approved = lookups.approved_only(t, "sheet", "p_partkey", ["III", "IV"]).select("sheet", F.col("p_partkey").alias("approved"))
    return best.join(approved, "sheet", "left").join(t.groupBy("sheet").agg(F.count_if("draft").alias("n_drafts")), "sheet")


@query("""
  WITH a AS (SELECT p_partkey AS ord, p_size || '-' || p_partkey % 20 AS id FROM part), q AS (SELECT DISTINCT p_size || '-0' || p_partkey % 20 AS text FROM part),
  n AS (SELECT text, text AS k FROM q UNION SELECT text, split_part(text, '-', 1) || '-' || CAST(split_part(text, '-', 2) AS INT) FROM q)
  SELECT text, min(ord) AS ord, arg_min(id, ord) AS id FROM n JOIN a ON id = k GROUP BY text
""")
def arrangement_lookup(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda mid: F.concat(s.cast("string"), F.lit(mid), (k % 20).cast("string"))
    p = table(spark, sf_dir, "part")
    return lookups.lookup_arrangement(p.select(text("-0").alias("text")), "text", p.select(k.alias("ord"), text("-").alias("id")), "ord")


@query("""
  WITH a AS (SELECT * FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)), b AS (SELECT * FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part))
  SELECT 'p_brand' AS field, a.p_brand AS left, b.p_brand AS right, a.p_brand = b.p_brand AS same FROM a, b UNION ALL SELECT 'p_size', a.p_size::VARCHAR, b.p_size::VARCHAR, a.p_size = b.p_size FROM a, b
""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def compare_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    low, high = p.agg(F.min("p_partkey"), F.max("p_partkey")).first()  # two numbers
    return lookups.compare_two(p, "p_partkey", F.lit(low), F.lit(high))


@query("""
  SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_partkey % 5 = 0 THEN 'odd id' END) AS issues FROM part WHERE p_size > 40 OR p_partkey % 5 = 0
""")
def review_queue(spark, sf_dir):
    out = lookups.review_queue(table(spark, sf_dir, "part"), "p_partkey", {"large": F.col("p_size") > 40, "odd id": F.col("p_partkey") % 5 == 0})
    return out.select("p_partkey", F.array_join("issues", ",").alias("issues"))


@query("""
  WITH o AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY ALL)
  SELECT c_custkey AS k, coalesce(n, 0) AS n, coalesce(last, -1) AS last FROM customer LEFT JOIN o ON k = c_custkey
""")
def records_with_defaults(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return lookups.with_defaults(o, keys, "k", {"n": F.lit(0).cast("long"), "last": F.lit(-1).cast("long")})


@query(f"""
  WITH t AS (SELECT p_partkey AS id, {pick_sql(["exact match", "verified", "other"], "p_partkey % 3")} AS status, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS s, CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END AS r FROM part)
  SELECT id, CASE WHEN status <> 'other' AND s <> '' THEN 'Validation sources: ' || s WHEN r <> '' THEN r WHEN s <> '' THEN 'Sources: ' || s ELSE 'Validation source is not available.' END AS words FROM t
""")
def validation_words(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    some = lambda cond, c: F.when(cond, F.array(c)).otherwise(F.array().cast("array<string>"))
    words = lookups.evidence_text(pick(["exact match", "verified", "other"], k % 3), some(s % 2 == 0, "p_brand"), some(s % 3 == 0, "p_name"))
    return table(spark, sf_dir, "part").select(k.alias("id"), words.alias("words"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(trim(p_name)) = lower((SELECT min(p_name) FROM part))")
def exact_hits(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    word = p.agg(F.min("p_name")).first()[0]  # one text
    return lookups.exact_hits(p, "p_name", F.lit(word).cast("string"))


@query(f"""
  WITH f AS (SELECT p_partkey AS id, {pick_sql(["usb", "hdmi", "rj"], "p_size % 3")} AS family, {pick_sql(["plug", "receptacle"], "p_partkey % 2")} AS role, p_brand || '/' || p_partkey AS pn, p_size % 4 = 0 AS verified FROM part),
  r AS (SELECT *, row_number() OVER (PARTITION BY family, role ORDER BY verified DESC, pn) AS place FROM f)
  SELECT f.id, r.pn AS mate, r.place::INT AS place FROM f JOIN r ON f.family = r.family AND f.role <> r.role WHERE r.place <= 12
""")
def rugged_mates(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    f = table(spark, sf_dir, "part").select(
        k.alias("id"), pick(["usb", "hdmi", "rj"], s % 3).alias("family"), pick(["plug", "receptacle"], k % 2).alias("role"), F.concat("p_brand", F.lit("/"), k.cast("string")).alias("pn"), (s % 4 == 0).alias("verified")
    )
    return lookups.other_role(f, "family", "role", "pn", 12).select("id", "mate", "place")
