"""Queries that audit a catalog, cross-check other sources and sum parts up in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions import labels
from partlake.operators import audits, decode, htmlscan
from partlake.operators.spread import spread
from partlake.plans.labels import pick, pick_sql
from partlake.plans.queries import _GRAMMAR_SQL, _LIST, _PIN, PARSED, distinct_parsed, query, table
from partlake.scratch import Scratch
from partlake.sources.feed import part_feed

_SHELLS, _LETTERS = [n for _, n in R.SHELL_SIZES], [c for c, _ in R.SHELL_SIZES]
_RATED = [s for s, *_ in R.RATINGS]
_GIVEN = ["22D", "20", "16", "12", "99"]
_STATUS = "CASE WHEN n_bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status"


def _rows(checks: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{n}' AS "check", count(*) AS n_rows, count(*) FILTER (NOT coalesce({c}, false)) AS n_bad FROM {source}""" for n, c in checks.items())


@query(f"""
  WITH p AS (SELECT p_partkey AS k, {pick_sql(_SHELLS, "p_size % 9")} AS shell, CASE WHEN p_partkey % 50 = 0 THEN 'J' WHEN p_partkey % 51 = 0 THEN '?' ELSE {pick_sql(_LETTERS, "p_size % 9")} END AS code FROM part),
  a0 AS (SELECT *, CASE WHEN k % 97 = 0 THEN 'dup' ELSE shell || '-' || k END AS id FROM p),
  l AS (SELECT a0.id, l_partkey, CASE WHEN l_orderkey % 501 = 0 THEN NULL WHEN l_orderkey % 502 = 0 THEN '?' ELSE l_orderkey || ':' || l_linenumber END AS label,
      CASE WHEN l_suppkey % 31 = 0 THEN NULL ELSE l_discount END AS x, l_tax AS y, {pick_sql(_GIVEN, "l_suppkey % 5")} AS size FROM lineitem JOIN a0 ON k = l_partkey),
  c AS (SELECT id, count(*) AS n, count(DISTINCT label) + max((label IS NULL)::INT) AS n_labels, count(*) FILTER (label IS NULL OR label = '?') AS n_blank FROM l GROUP BY id),
  m AS (SELECT l_partkey AS k, count(*) AS made FROM lineitem GROUP BY ALL),
  a AS (SELECT a0.*, coalesce(made, 0) + (k % 40 = 0)::INT AS contact_count, CASE WHEN k % 3 = 0 THEN coalesce(made, 0) END AS expected, coalesce(n, 0) AS n, coalesce(n_labels, 0) AS n_labels, coalesce(n_blank, 0) AS n_blank FROM a0 LEFT JOIN m USING (k) LEFT JOIN c USING (id)),
  z(code, s) AS (VALUES {R.values(R.SHELL_SIZES)}),
  r AS (SELECT a.*, z.s FROM a LEFT JOIN z ON z.code = a.code),
  d AS (SELECT count(*) AS n FROM a GROUP BY id),
  u AS ({_rows({"id reads shell-number": "id = shell || '-' || k", "shell is its code''s": "s IS NULL OR s = shell", "contacts as counted": "contact_count = n", "contacts as expected": "expected IS NULL OR expected = n", "labels there": "n_blank = 0", "labels unique": "n_labels = n"}, "r")}
    UNION ALL SELECT 'id unique', sum(n)::BIGINT, count(*) FILTER (n > 1) FROM d
    UNION ALL {_rows({"contact placed": "x IS NOT NULL AND y IS NOT NULL", "contact size rated": f"size IN ({_LIST(_RATED)})"}, "l")}
    UNION ALL SELECT 'number of arrangements', count(*), abs(count(*) - 2000) FROM a UNION ALL SELECT 'number of contacts', count(*), abs(count(*) - 60000) FROM l)
  SELECT *, {_STATUS} FROM u
""")
def arrangement_checks(spark, sf_dir):
    """What must hold of arrangements and contacts, on parts and their lines, of which some are spoilt."""
    k, s = F.col("p_partkey"), F.col("p_size")
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select(k, pick(_SHELLS, s % 9).alias("shell"), F.when(k % 50 == 0, "J").when(k % 51 == 0, "?").otherwise(pick(_LETTERS, s % 9)).alias("code"), k.cast("string").alias("number"))
    p = p.withColumn("id", F.when(k % 97 == 0, "dup").otherwise(F.concat_ws("-", "shell", "number")))
    made = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("made"))
    a = p.join(made, "p_partkey", "left").withColumn("made", F.coalesce("made", F.lit(0)))
    a = a.withColumns({"contact_count": F.col("made") + (k % 40 == 0).cast("int"), "expected_count": F.when(k % 3 == 0, F.col("made"))})
    o = F.col("l_orderkey")
    label = F.when(o % 501 == 0, None).when(o % 502 == 0, "?").otherwise(F.concat_ws(":", o.cast("string"), F.col("l_linenumber").cast("string")))
    c = li.join(p.select(k.alias("l_partkey"), "id"), "l_partkey").select("id", label.alias("label"), F.when(F.col("l_suppkey") % 31 != 0, F.col("l_discount")).alias("x"), F.col("l_tax").alias("y"), pick(_GIVEN, F.col("l_suppkey") % 5).alias("size"))
    return audits.check_arrangements(a, c, _RATED, 2000, 60000)


_KNOWN = ["W", "F", "K", "Z", "J", "AA"]


@query(rf"""
  WITH g AS ({_GRAMMAR_SQL}), c AS (SELECT *, regexp_replace(upper(raw_pn), '\s', '', 'g') AS pn FROM g WHERE sheet IS NOT NULL),
  k AS (SELECT *, regexp_extract(pn, '^D38999/(\d\d)', 1) AS lead, CASE WHEN regexp_extract(pn, '^D38999/(\d\d)', 1) IN ({_LIST(R.ACCESSORY_SHEETS)}) THEN 'accessory' WHEN grammar = 'lanyard' THEN 'variant' ELSE 'insert' END AS kind FROM c),
  p AS (SELECT kind, CASE WHEN lead = '' THEN 'no sheet' WHEN sheet <> '' AND lead <> sheet THEN 'sheet differs'
    WHEN kind = 'accessory' THEN CASE WHEN class <> '' AND class NOT IN ({_LIST(_KNOWN)}) THEN 'unknown class' END
    WHEN kind = 'variant' THEN CASE WHEN size <> '' AND size NOT IN ({_LIST(_LETTERS)}) THEN 'unknown size' WHEN class <> '' AND class NOT IN ({_LIST(_KNOWN)}) THEN 'unknown class' END
    WHEN NOT regexp_matches(pn, '{_PIN}') THEN 'no insert pattern' WHEN class IS NOT NULL AND regexp_extract(pn, '{_PIN}', 2) <> class THEN 'class differs'
    WHEN size IS NOT NULL AND regexp_extract(pn, '{_PIN}', 3) <> size THEN 'size differs' WHEN contact IS NOT NULL AND regexp_extract(pn, '{_PIN}', 5) <> contact THEN 'contact differs'
    WHEN regexp_extract(pn, '{_PIN}', 2) NOT IN ({_LIST(_KNOWN)}) THEN 'unknown class' WHEN NOT contains('{R.KNOWN_CONTACT_LETTERS}', regexp_extract(pn, '{_PIN}', 5)) THEN 'contact not documented' END AS problem FROM k)
  SELECT kind, coalesce(problem, 'ok') AS problem, count(*) AS n FROM p GROUP BY ALL
""")
def numbers_audited(spark, sf_dir):
    """Decoded numbers against the published pattern, by class of sheet."""
    d = decode.decode_grammars(part_feed(spark, sf_dir).select("raw_pn").distinct())
    none = F.lit(None).cast("string")
    d = d.select(F.regexp_replace(F.upper("raw_pn"), r"\s", "").alias("pn"), "sheet", "class", "size", "contact", none.alias("key"), F.when(F.col("grammar") == "lanyard", "x").alias("lanyard"), none.alias("type"))
    d = Scratch(spark, "audit").write(d, "decoded", keep=True).where("sheet IS NOT NULL")  # decoding and checking in one stage make more code than a method may hold
    out = audits.check_numbers(d, "pn", _KNOWN, list(R.KNOWN_CONTACT_LETTERS))
    return out.groupBy("kind", F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


_FAMILIES = [(0, "233-105", "mighty", "x"), (1, "233", "wide", "x"), (2, "800-00", "eight", "y"), (3, "RJF", "field", "y")]
_NUMS = ["233-105-G6", "233-106-00", "800-001-06", "800-002", "RJF-2", "999-001", "233 105"]


@query(f"""
  WITH n AS (SELECT p_partkey, {pick_sql(_NUMS, "p_partkey % 7")} || '-' || p_size AS number FROM part),
  m AS (SELECT *, replace(replace(number, '-', ''), ' ', '') AS x, regexp_extract(number, '^(\\d{{3}}-\\d{{3}})', 1) AS base FROM n),
  f AS (SELECT *, CASE WHEN starts_with(x, '233105') THEN 'mighty' WHEN starts_with(x, '233') THEN 'wide' WHEN starts_with(x, '80000') THEN 'eight' WHEN starts_with(x, 'RJF') THEN 'field' END AS family FROM m)
  SELECT p_partkey, number, family, CASE WHEN family IS NULL THEN 'not recognised' WHEN base = '' OR replace(base, '-', '') = CASE family WHEN 'mighty' THEN '233105' WHEN 'wide' THEN '233' WHEN 'eight' THEN '80000' ELSE 'RJF' END THEN 'ok'
    WHEN replace(base, '-', '') IN ('233105', '233', '80000', 'RJF') THEN 'other series' ELSE 'unknown base' END AS verdict FROM f
""")
def families_checked(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", pick(_NUMS, F.col("p_partkey") % 7), F.col("p_size").cast("string")).alias("number"))
    return audits.check_families(p, "number", _FAMILIES)


@query(f"""
  WITH {PARSED}, e AS (SELECT DISTINCT coalesce(normalized, raw_pn) AS number, CASE WHEN error IS NULL THEN sheet END AS sheet, CASE WHEN error IS NULL THEN contact END AS contact, CASE WHEN error IS NULL THEN key END AS position FROM parsed),
  v AS (SELECT number, 'm' || length(number) % 4 AS maker FROM e WHERE ascii(right(number, 2)) % 3 = 0),
  ct AS (SELECT {pick_sql(["20", "24", "26", "XX"], "p_partkey % 4")} AS sheet, CASE WHEN p_size % 3 = 0 THEN 'P' ELSE 'PS' END AS contacts, CASE WHEN p_size % 5 = 0 THEN 'N' ELSE 'NAB' END AS positions, p_brand || '/' || p_size % 2 AS source FROM part),
  s AS (SELECT number, list(DISTINCT source ORDER BY source) AS sources FROM e JOIN ct ON ct.sheet = e.sheet AND contains(contacts, contact) AND contains(positions, position) GROUP BY number)
  SELECT e.number, v.number IS NOT NULL AS verified, coalesce(maker, '') AS maker, coalesce(array_to_string(sources, ','), '') AS sources, sources IS NOT NULL AS importable FROM e LEFT JOIN v ON v.number = e.number LEFT JOIN s ON s.number = e.number
""")
def sources_cross_checked(spark, sf_dir):
    """Entries of another source against verified numbers and what catalogs support."""
    d, ok = distinct_parsed(spark, sf_dir), F.col("error").isNull()
    e = d.select(F.coalesce("normalized", "raw_pn").alias("number"), F.when(ok, F.col("sheet")).alias("sheet"), F.when(ok, F.col("contact")).alias("contact"), F.when(ok, F.col("key")).alias("position")).distinct()
    e = Scratch(spark, "entries").write(e, "decoded", keep=True)  # asked for three times: the feed is parsed once
    v = e.where(F.ascii(F.right("number", F.lit(2))) % 3 == 0).select("number", F.concat(F.lit("m"), (F.length("number") % 4).cast("string")).alias("maker"))
    k, s = F.col("p_partkey"), F.col("p_size")
    letters = lambda x: F.array(*[F.lit(c) for c in x])
    c = table(spark, sf_dir, "part").select(
        pick(["20", "24", "26", "XX"], k % 4).alias("sheet"), F.when(s % 3 == 0, letters("P")).otherwise(letters("PS")).alias("contacts"),
        F.when(s % 5 == 0, letters("N")).otherwise(letters("NAB")).alias("positions"), F.concat_ws("/", "p_brand", (s % 2).cast("string")).alias("source"),
    )
    out = audits.cross_check(e, v, c, "number")
    return out.select("number", "verified", "maker", F.array_join("sources", ",").alias("sources"), "importable")


@query("""
  SELECT s_suppkey AS id, s_suppkey * 10 + i AS row, CASE WHEN i = 2 THEN '' ELSE s_suppkey || 'C' END AS cage, CASE WHEN i = 2 THEN '' ELSE s_name || ' & Co' END AS company, CASE WHEN i = 1 THEN 'US' ELSE '' END AS country,
    'P-' || s_suppkey AS part, CASE WHEN i = 1 THEN 'note ' || s_nationkey ELSE '' END AS note, CASE i WHEN 0 THEN 'certified' WHEN 1 THEN 'inactive' ELSE '' END AS status
  FROM supplier, range(3) t(i)
""")
def maker_details(spark, sf_dir):
    """Makers of a detail page: three control numbers with cells of their own, one without any, one cell told twice."""
    k = F.col("s_suppkey").cast("string")
    cell = lambda i, f, *v: F.concat(F.lit('<td><span id="g_ctl'), k, F.lit(f'{i}_lbl{f}">'), *[F.lit(x) if isinstance(x, str) else x for x in v], F.lit("</span></td>\n"))
    icon = lambda i, alt: F.concat(F.lit('<img id="g_ctl'), k, F.lit(f'{i}_imgStatus" src="x.png" alt="{alt}">'))
    html = F.concat(
        cell(0, "CAGECode", "old"), cell(0, "CAGECode", k, "C"), cell(0, "Company", "<b>", F.col("s_name"), "</b> &amp; Co"), cell(0, "MfgPart", "P-", k), icon(0, "Certified source"),
        cell(1, "CAGECode", k, "C"), cell(1, "Company", F.col("s_name"), " &amp; Co"), cell(1, "Country", "US"), cell(1, "MfgPart", "P-", k, " (note ", F.col("s_nationkey").cast("string"), ")"), icon(1, "Not certified"),
        cell(2, "MfgPart", "P-", k), cell(3, "Country", "XX"), icon(3, "Certified"),
    )
    return htmlscan.detail_rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), html.alias("html")), "id", "html")


_FACES = ["RJ45", "USB-C", "USB 3", "HDMI", "other"]
_VENDORS = ["Glenair Inc", "amphenol", "Acme", ""]
_ORDER = ["RJ45 / Ethernet", "USB", "USB-C", "HDMI", "DisplayPort", "Other"]
_ENTRY = f"""SELECT p_partkey, {pick_sql(_FACES, "p_partkey % 5")} AS interface, {pick_sql(_VENDORS, "p_partkey % 4")} AS vendor, {pick_sql(_SHELLS, "p_size % 9")} AS shell, p_name AS family, p_type AS relation,
  {pick_sql(["RJ45 / Ethernet", "USB-C", "USB", "HDMI", "Other"], "p_partkey % 5")} AS category, {pick_sql(["Glenair", "Amphenol", "Acme", "Other"], "p_partkey % 4")} AS label FROM part"""


def _entries(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", pick(_FACES, k % 5).alias("interface"), pick(_VENDORS, k % 4).alias("vendor"), pick(_SHELLS, F.col("p_size") % 9).alias("shell"), F.col("p_name").alias("family"), F.col("p_type").alias("relation"))


@query(f"WITH e AS ({_ENTRY}) SELECT p_partkey, category, label FROM e WHERE category = 'USB-C' AND label = 'Glenair' AND contains(lower(family || ' ' || interface || ' ' || vendor || ' ' || relation), 'ring')")
def interfaces_filtered(spark, sf_dir):
    return audits.interface_filter(_entries(spark, sf_dir), "USB-C", "Glenair", "", " Ring ").select("p_partkey", "category", "label")


@query(f"""
  WITH e AS ({_ENTRY}), c AS (SELECT DISTINCT category FROM e), v AS (SELECT DISTINCT label FROM e), s AS (SELECT DISTINCT shell FROM e)
  SELECT 'category' AS facet, (row_number() OVER (ORDER BY list_position([{_LIST(_ORDER)}], category)) - 1)::INT AS place, category AS value FROM c
  UNION ALL SELECT 'vendor', (row_number() OVER (ORDER BY label) - 1)::INT, label FROM v UNION ALL SELECT 'shell', (row_number() OVER (ORDER BY shell::INT) - 1)::INT, shell FROM s
""")
def interface_facets(spark, sf_dir):
    return audits.interface_facets(_entries(spark, sf_dir), _ORDER)


_STYLES = ["straight plug", "", "wall mount receptacle"]
_DESC = ["Straight  plug.", "a receptacle with a flange", ""]
_CONTACT = ["P", "S", "?"]


@query(f"""
  WITH p AS (SELECT p_partkey, p_size, {pick_sql(_STYLES, "p_partkey % 3")} AS style, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_size::VARCHAR END AS shell, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_size || '-' || p_partkey END AS arrangement,
      {pick_sql(["using pin contacts", "using socket contacts", ""], "p_partkey % 3")} AS contact, {pick_sql(["Straight plug.", "a receptacle with a flange.", ""], "p_size % 3")} AS description,
      CASE p_partkey % 4 WHEN 0 THEN 'Rated for service.' WHEN 1 THEN 'The loaded data points to high temp and emi service.' WHEN 2 THEN 'Environment tags include Marine, Space, and Ground Use.' ELSE '' END AS service FROM part),
  s AS (SELECT *, CASE WHEN style = '' THEN 'Connector' ELSE style END || ', ' || CASE WHEN shell = '' THEN 'shell size not specified' ELSE 'shell size ' || shell END || ', '
      || CASE WHEN arrangement = '' THEN 'insert arrangement is not specified' ELSE 'insert arrangement ' || arrangement END || CASE WHEN contact = '' THEN '' ELSE ', ' || contact END || '.' AS lead FROM p),
  t AS (SELECT p_partkey, array_to_string(list_filter([lead, description, CASE WHEN p_size % 2 = 0 THEN 'Listed by ' || repeat('Acme ', 70) || 'and others.' END, service, CASE WHEN contact = '' THEN 'Contact gender is not specified.' END], lambda x: x <> ''), ' ') AS text FROM s)
  SELECT p_partkey, CASE WHEN length(text) > 420 THEN rtrim(substr(text, 1, 417)) || '...' ELSE text END AS summary FROM t
""")
def human_summaries(spark, sf_dir):
    """Parts in a few sentences, at most 420 characters."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("score"))
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        k, s, pick(_STYLES, k % 3).alias("style"), F.when(s % 4 == 0, "").otherwise(s.cast("string")).alias("shell"),
        F.when(k % 5 == 0, "").otherwise(F.concat_ws("-", s.cast("string"), k.cast("string"))).alias("arrangement"), pick(_CONTACT, k % 3).alias("contact"), pick(_DESC, s % 3).alias("description"),
        F.when(k % 4 == 0, "Rated  for service. And more.").alias("note"), F.when(k % 4 == 1, F.array(pair("high_temp", 4), pair("emi", 5), pair("space", 3))).alias("scores"),
        F.when(k % 4 == 2, F.array(*[F.lit(x) for x in ("marine", "Marine", "space", "ground_use", "emi")])).alias("tags"),
    )
    evidence = F.when(s % 2 == 0, F.concat(F.lit("Listed by "), F.call_function("repeat", F.lit("Acme "), F.lit(70)), F.lit("and others")))
    summary = audits.human_summary("style", "shell", "arrangement", labels.contact_summary("contact"), "description", evidence, audits.environment_sentence("note", "scores", "tags"))
    return p.select("p_partkey", summary.alias("summary"))
