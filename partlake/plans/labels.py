"""Queries on catalog texts: cells, sizes, roles, ratings, materials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions import labels as L
from partlake.plans.queries import _LIST, query, table


def pick(xs: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in xs]), at.cast("int"))


def pick_sql(xs: list, at: str) -> str:
    items = ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs)
    return f"[{items}][CAST({at} AS INT) + 1]"


def case_sql(text: str, steps: list[tuple[str, str]], otherwise: str = "''") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{v}'" for p, v in steps) + f" ELSE {otherwise} END"


CELLS = ["ABC-12 ( )", "<b>XY-9</b> ( LOT 3 )", "ZZ1 - (-)", "", "Q7&amp;R  (see note)"]
ALTS = ["Certified source", "Not certified", "No longer made", "Inactive", " Pending ", "not listed"]


@query(rf"""
  WITH c AS (SELECT p_partkey, {pick_sql(CELLS, "p_partkey % 5")} AS cell, {pick_sql(ALTS, "p_size % 6")} AS alt FROM part),
  t AS (SELECT *, trim(regexp_replace(replace(regexp_replace(cell, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS x FROM c),
  n AS (SELECT *, trim(regexp_replace(x, '^[^ ]*', ''), '()- ') AS note FROM t)
  SELECT p_partkey, split_part(x, ' ', 1) AS token, CASE WHEN regexp_matches(note, '[A-Za-z0-9]') THEN note ELSE '' END AS note,
    CASE WHEN lower(alt) LIKE '%certified%' AND lower(alt) NOT LIKE '%not%' THEN 'certified'
         WHEN lower(alt) LIKE '%inactive%' OR lower(alt) LIKE '%no longer%' OR lower(alt) LIKE '%not %' THEN 'inactive' ELSE trim(alt) END AS status
  FROM n
""")
def list_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("cell", pick(CELLS, F.col("p_partkey") % 5)).withColumn("alt", pick(ALTS, F.col("p_size") % 6))
    return p.select("p_partkey", L.vendor_token("cell").alias("token"), L.vendor_note("cell").alias("note"), L.status_of_alt("alt").alias("status"))


SIZES = ["#22D", " # 8  coax", "#8 twinax", "12", "#16 "]
IDS = ["25-007", "9-35", "11-000", "17", "13-08"]
LINES = ["-.125 in", "12 holes", "+3.50", "0.5,", "A 1.5"]
TITLES = ["Arrangement 25-7 M 2 x #8 Coax, 97 #22D", "11-35 II", "9-35 13 #22D", "no id", "17-26 INST 26 #20"]
STYLES = ["/20 WB /24", "26", "A/7 WX", "/46/47", ""]


@query(rf"""
  WITH c AS (SELECT p_partkey, {pick_sql(SIZES, "p_partkey % 5")} AS size, {pick_sql(IDS, "p_size % 5")} AS id, {pick_sql(LINES, "(p_partkey + p_size) % 5")} AS line,
      {pick_sql(TITLES, "p_partkey // 5 % 5")} AS title, {pick_sql(STYLES, "p_size // 5 % 5")} AS style FROM part),
  r AS (SELECT *, trim(regexp_extract(title, '^.*?\d{{1,2}}-\d{{1,3}}(.*)$', 1)) AS rest FROM c)
  SELECT p_partkey,
    replace(replace(trim(regexp_replace(replace(size, '#', ''), '\s+', ' ', 'g')), 'coax', 'Coax'), 'twinax', 'Twinax') AS size,
    CASE WHEN contains(id, '-') THEN split_part(id, '-', 1) || '-' || CAST(CAST(split_part(id, '-', 2) AS INT) AS VARCHAR) ELSE id END AS id,
    TRY_CAST(nullif(regexp_extract(line, '^[+-]?\d*\.\d+'), '') AS DOUBLE) AS number,
    CASE WHEN regexp_matches(rest, '\d+\s*x?\s*#') THEN coalesce(nullif(trim(regexp_extract(rest, '^(.*?)\d+\s*x?\s*#', 1)), ''), 'unknown')
         WHEN rest = '' THEN 'unknown' ELSE split_part(rest, ' ', 1) END AS rating,
    array_to_string(list_filter(regexp_split_to_array(style, '[\s/]+'), lambda p: regexp_full_match(p, '\d\d+')), ',') AS sheets
  FROM r
""")
def sizes_and_ids(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").withColumns(
        {"size": pick(SIZES, k % 5), "id": pick(IDS, s % 5), "line": pick(LINES, (k + s) % 5), "title": pick(TITLES, F.floor(k / 5) % 5), "style": pick(STYLES, F.floor(s / 5) % 5)}
    )
    return p.select(
        "p_partkey", L.clean_size("size").alias("size"), L.arrangement_id("id").alias("id"), L.leading_decimal("line").alias("number"),
        L.service_rating("title").alias("rating"), F.array_join(L.sheets_of_style("style"), ",").alias("sheets"),
    )


TEXTS = ["Straight plug, cable side", "Jam nut receptacle", "Wall-mount female, no jam nut", "USB-C cordset", "Bulkhead feedthru jack", "", "Square flange or jam-nut receptacle and plug", "Protective cap", "Male panel"]
INTERFACES = ["RJ45 field", "10G Ethernet", "USB Type-C", "USB 3", "HDMI 2", "DisplayPort", "serial"]
MAKERS = ["Glenair Inc", "AMPHENOL", "TE Connectivity", " Souriau ", "", "Cinch"]
_KINDS = [("square-flange", "square[- ]?flange"), ("jam-nut", "jam[- ]?nut"), ("wall-mount", "wall[- ]?mount")]


@query(rf"""
  WITH c AS (SELECT p_partkey, {pick_sql(TEXTS, "p_partkey % 9")} AS x, {pick_sql(INTERFACES, "p_size % 7")} AS i, {pick_sql(MAKERS, "p_size % 6")} AS v FROM part),
  t AS (SELECT *, lower(x) AS t, lower(i) AS li, lower(v) AS lv,
      list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(x), '{p}') AND NOT regexp_matches(lower(x), 'no {p}') THEN '{k}' END" for k, p in _KINDS)}], lambda k: k IS NOT NULL) AS kinds FROM c),
  s AS (SELECT *, concat_ws(', ', CASE WHEN regexp_matches(t, '\bplug\b|free connector|cable[- ]?side|cable plug|cordset') THEN 'plug' END,
      CASE WHEN len(kinds) > 0 THEN array_to_string(kinds, ' / ') || CASE WHEN len(kinds) > 1 THEN ' receptacles' ELSE ' receptacle' END WHEN regexp_matches(t, 'receptacle|jack') THEN 'panel receptacle' END,
      CASE WHEN regexp_matches(t, 'feed[- ]?thr(u|ough)') THEN 'feedthrough' END, CASE WHEN contains(t, 'bulkhead') THEN 'bulkhead' END) AS summary FROM t)
  SELECT p_partkey, CASE WHEN regexp_matches(t, '{L.MALE}') THEN 'male' WHEN regexp_matches(t, '{L.FEMALE}') THEN 'female' END AS gender,
    CASE WHEN contains(t, 'female') THEN 'female+male' WHEN contains(t, 'male') THEN 'male' ELSE '' END AS gender_key,
    CASE WHEN summary = '' THEN 'none' ELSE summary END AS summary, {case_sql("t", L.ROLES)} AS role,
    CASE WHEN {case_sql("t", L.MOUNTING)} = '' AND {case_sql("t", L.ROLES)} = 'plug' THEN 'cable' ELSE {case_sql("t", L.MOUNTING)} END AS mounting,
    {case_sql("li", L.CATEGORIES, "'Other'")} AS category, coalesce({case_sql("lv", L.VENDORS, "NULL")}, nullif(trim(v), ''), 'Other') AS vendor
  FROM s
""")
def roles_and_genders(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").withColumns({"x": pick(TEXTS, k % 9), "i": pick(INTERFACES, s % 7), "v": pick(MAKERS, s % 6)})
    return p.select(
        "p_partkey", L.gender("x").alias("gender"), L.gender_key("x").alias("gender_key"), L.gender_summary("x", F.lit("none")).alias("summary"),
        L.mounting_role("x").alias("role"), L.mounting_style("x", L.mounting_role("x")).alias("mounting"),
        L.interface_category("i").alias("category"), L.vendor_label("v").alias("vendor"),
    )


KINDS = ["", "Coax", "quadrax", "signal"]
RATINGS = ["M", "II", "Il.", "Inst", "Fiber Optic", "N", "l", "Coax", "?"]
STATES = ["exact match", "valid format, not confirmed", "invalid combination", "vendor specific", "other", "verified"]
TRUST = ["standard_reference", "high", "low", ""]


@query(f"""
  WITH c AS (SELECT p_partkey, {pick_sql(SIZES, "p_partkey % 5")} AS size, {pick_sql(KINDS, "p_partkey % 4")} AS kind, {pick_sql(RATINGS, "p_partkey % 9")} AS rating,
      {pick_sql(STATES, "p_size % 6")} AS state, {pick_sql(TRUST, "p_size % 4")} AS trust, {pick_sql(list("PSABHJCDXYZ?"), "p_partkey % 12")} AS contact FROM part),
  x AS (SELECT *, lower(kind || ' ' || size) AS bth, regexp_replace(lower(rating), '[^a-z]', '', 'g') AS core FROM c),
  d(contact, meaning) AS (VALUES {R.values(R.CONTACTS)}),
  g AS (SELECT x.*, meaning, {case_sql("lower(coalesce(meaning, ''))", [(chr(92) + "bpin" + chr(92) + "b", "pin"), (chr(92) + "bsocket" + chr(92) + "b", "socket")])} AS gender FROM x LEFT JOIN d USING (contact))
  SELECT p_partkey, {case_sql("lower(size)", L.GAUGES, "'unknown'")} AS gauge, {case_sql("bth", L.SHIELDED)} AS shield,
    CASE {case_sql("bth", L.SHIELDED)} WHEN 'coax' THEN 1 WHEN 'twinax' THEN 2 WHEN 'quadrax' THEN 4 ELSE 0 END AS bores,
    CASE WHEN contains(lower(rating), 'fiber') THEN 'fiber' WHEN contains(lower(rating), 'coax') THEN 'coax' WHEN contains(lower(rating), 'inst') THEN 'inst'
      WHEN core IN ('n', 'm') THEN core WHEN core IN ('ii', 'il', 'll') THEN 'ii' WHEN core IN ('i', 'l') THEN 'i' ELSE 'unknown' END AS bucket,
    {case_sql("state", L.STATUS_LABELS, "'missing data'")} AS label, state IN ('exact match', 'verified', 'secondary exact') AS exact,
    CASE trust WHEN 'standard_reference' THEN 'MIL-STD-1560' WHEN 'high' THEN 'catalog PDF' WHEN '' THEN 'unknown' ELSE trust END AS provenance,
    gender, CASE WHEN gender <> '' THEN 'using ' || gender || ' contacts' WHEN meaning IS NOT NULL THEN 'contact style: ' || meaning ELSE 'Contact gender is not specified.' END AS words,
    gender = 'socket' AS mirrored FROM g
""")
def contact_labels(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").withColumns(
        {"size": pick(SIZES, k % 5), "kind": pick(KINDS, k % 4), "rating": pick(RATINGS, k % 9), "state": pick(STATES, s % 6), "trust": pick(TRUST, s % 4), "contact": pick(list("PSABHJCDXYZ?"), k % 12)}
    )
    g = p.withColumn("gender", L.contact_gender("contact"))
    return g.select(
        "p_partkey", L.gauge("size").alias("gauge"), L.shield("kind", "size").alias("shield"), L.bores("kind", "size").alias("bores"),
        L.service_bucket("rating").alias("bucket"), L.status_label("state").alias("label"), L.is_exact_status("state").alias("exact"),
        L.label_provenance("trust").alias("provenance"), "gender", L.contact_summary("contact").alias("words"),
        L.face_is_mirrored("gender", F.lit("front")).alias("mirrored"),
    )


@query(f"""
  WITH c AS (SELECT p_partkey, p_size, [p_size / 50.0, (p_partkey % 11) / 10.0, (p_partkey % 3) / 20.0] AS rgb FROM part)
  SELECT p_partkey, '#' || array_to_string(list_transform(rgb, lambda v: lpad(lower(to_hex(CAST(round_even(v * 255, 0) AS INT))), 2, '0')), '') AS hex,
    list_max(rgb) < 0.2 AS black, 'std.pdf p. ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ', Table ' || p_partkey ELSE '' END AS cited,
    {pick_sql(["233-105-G6", "AB-1", "23-105"], "p_partkey % 3")}[1:CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE 0 END] AS base,
    CASE WHEN p_size % 2 = 0 THEN '3 May ' || p_size ELSE '' END AS dated FROM c
""")
def colors_and_citations(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").withColumn("rgb", F.array(s / 50.0, (k % 11) / 10.0, (k % 3) / 20.0))
    text = F.when(s % 2 == 0, F.concat(F.lit("Title\nDated: 3 May "), s.cast("string"), F.lit("\nx"))).otherwise("no date")
    return p.select(
        "p_partkey", L.color_hex("rgb").alias("hex"), L.is_black("rgb").alias("black"),
        L.citation(F.lit("std.pdf"), s, F.when(k % 2 == 0, F.concat(F.lit("Table "), k.cast("string")))).alias("cited"),
        L.base_number(pick(["233-105-G6", "AB-1", "23-105"], k % 3)).alias("base"), L.dated(text).alias("dated"),
    )


DESCRIBED = ["Composite, olive drab", "Aluminum nickel bronze", "stainless steel, threaded", "Aluminum with breech coupling", "", "corrosion resistant steel with pins", "wired sockets"]


@query(f"""
  WITH c AS (SELECT p_partkey, {pick_sql(DESCRIBED, "p_partkey % 7")} AS d, {pick_sql(["W", "N", "B", "K", "L"], "p_size % 5")} AS cls, {pick_sql(["III", "IV", "II"], "p_size % 3")} AS series,
      {pick_sql(["A", "17", "BX", "?", ""], "p_partkey % 5")} AS code, {pick_sql(list("PSZ"), "p_size % 3")} AS contact, {pick_sql(["wall mount", "plug", ""], "p_partkey % 3")} AS mount FROM part), l AS (SELECT *, lower(d) AS x FROM c)
  SELECT p_partkey, CASE cls {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.CLASS_MATERIALS)} ELSE {case_sql("x", L.MATERIALS, "'unknown'")} END AS material,
    CASE WHEN contains(x, 'threaded') THEN 'threaded' WHEN contains(x, 'breech') THEN 'breech' WHEN series = 'III' THEN 'threaded' WHEN series = 'IV' THEN 'breech' ELSE 'unknown' END AS coupling,
    CASE WHEN regexp_full_match(code, '\\d+') THEN code ELSE coalesce(CASE code[1:1] {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in R.SHELL_SIZES)} END, 'unknown') END AS size,
    CASE WHEN contains(x, ' pins') THEN 'pin' WHEN contains(x, ' sockets') THEN 'socket' WHEN contact = 'P' THEN 'pin' ELSE 'socket' END AS contact_kind,
    CASE mount WHEN 'plug' THEN 'plug' WHEN '' THEN 'plug' ELSE 'wall mount plug' END AS style FROM l
""")
def shell_texts(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").withColumns(
        {"d": pick(DESCRIBED, k % 7), "cls": pick(["W", "N", "B", "K", "L"], s % 5), "series": pick(["III", "IV", "II"], s % 3), "code": pick(["A", "17", "BX", "?", ""], k % 5), "contact": pick(list("PSZ"), s % 3), "mount": pick(["wall mount", "plug", ""], k % 3)}
    )
    return p.select(
        "p_partkey", L.shell_material("d", "cls").alias("material"), L.coupling(F.lit(None).cast("string"), "d", "series").alias("coupling"),
        L.shell_size("code").alias("size"), L.contact_kind("d", "contact").alias("contact_kind"), L.shell_style("mount", F.lit("plug")).alias("style"),
    )
