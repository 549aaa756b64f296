"""One query for each operator family over the driver's tables, with the same result in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions import text as X
from partlake.operators import catalog, convert, corpus, decode, electrical, environment, geometry, htmlscan, quality, rugged, validate, windows
from partlake.sources.feed import FEED, part_feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the oracle's own building blocks --------------------------------------------------
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CLS = "(AA|AB|[ABCDEFGHJKLMNRSTUVWYZ])"
_PIN = rf"^D38999/(\d\d){_CLS}([A-HJ])(\d{{1,2}})([A-Z])([A-Z]?)$"
_SHEETS = _LIST(R.SERIES_III + R.SERIES_IV)
_NUM = "CASE size " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in R.SHELL_SIZES) + " END"
PARSED = rf"""
  feed AS ({FEED}),
  c AS (SELECT *, regexp_replace(upper(raw_pn), '[ \t\n-]', '', 'g') AS pn FROM feed),
  m AS (SELECT *, regexp_extract(pn, '^D38999/(\d\d)[A-Z0-9]+$', 1) AS sh,
               regexp_matches(pn, '{_PIN}') AS fits FROM c),
  g AS (SELECT * EXCLUDE (sh, fits),
          CASE WHEN sh = '' THEN 'not a pin' WHEN sh NOT IN ({_SHEETS}) THEN 'unsupported sheet'
               WHEN NOT fits THEN 'class not parsed' END AS error,
          CASE WHEN fits AND sh IN ({_SHEETS}) THEN sh END AS sheet FROM m),
  h AS (SELECT *, CASE WHEN sheet IS NOT NULL THEN CASE WHEN sheet < '40' THEN 'III' ELSE 'IV' END END AS series,
          CASE WHEN sheet IS NOT NULL THEN regexp_extract(pn, '{_PIN}', 2) END AS class,
          CASE WHEN sheet IS NOT NULL THEN regexp_extract(pn, '{_PIN}', 3) END AS size,
          CASE WHEN sheet IS NOT NULL THEN regexp_extract(pn, '{_PIN}', 4) END AS "insert",
          CASE WHEN sheet IS NOT NULL THEN regexp_extract(pn, '{_PIN}', 5) END AS contact,
          CASE WHEN sheet IS NOT NULL THEN CASE WHEN regexp_extract(pn, '{_PIN}', 6) = '' THEN 'N' ELSE regexp_extract(pn, '{_PIN}', 6) END END AS key
        FROM g),
  parsed AS (SELECT *, {_NUM} AS size_number, lpad({_NUM}, 2, '0') AS size_padded,
          'D38999/' || sheet || class || size || "insert" || contact || key AS normalized FROM h)
"""
RULE_COLS = "ord, vendor, line, fmt, rule_series, base, sizes, contacts, keys, rule_sheet, rule_class, style, finish"
FORWARD = f"""
  rule({RULE_COLS}) AS (VALUES {R.values(R.rule_rows())}),
  converted AS (
    SELECT parsed.*, rule.*, CASE fmt
        WHEN 'prefix' THEN style || size_number || '-' || "insert" || contact || key
        WHEN 'letter' THEN base || style || class || size || "insert" || contact || key
        WHEN 'BL' THEN base || style || finish || size_number || '-' || "insert" || contact || key
        WHEN 'base' THEN base || '-' || style || finish || size_padded || '-' || "insert" || contact || key
        WHEN 'T' THEN base || style || 'T' || size_number || finish || "insert" || contact || key
        WHEN '8D' THEN base || style || '-' || size_padded || finish || "insert" || contact || key
        WHEN 'DTS' THEN base || style || finish || size_number || "insert" || contact || key
        WHEN 'ACT' THEN base || style || finish || size || "insert" || contact || key END AS vendor_pn
    FROM parsed JOIN rule ON sheet = rule_sheet AND class = rule_class
    WHERE (sizes = '' OR contains(sizes, size)) AND contains(contacts, contact) AND contains(keys, key)
      AND NOT (vendor = 'Souriau' AND contact IN ('H', 'J') AND class NOT IN ('J', 'M')))
"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.parse_strict(part_feed(spark, sf_dir))


def distinct_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw number parsed once.

    The number hangs on a count, not on the grouping key alone: else the optimizer would copy
    the whole parse into a filter below the shuffle, once for each test of a part. A ``max`` of the
    number would do so, too, but sorts the whole feed.
    """
    once = part_feed(spark, sf_dir).groupBy(F.col("raw_pn").alias("pn")).agg(F.count("*").alias("n_lines"))
    return decode.parse_strict(once.select(F.when(F.col("n_lines") > 0, F.col("pn")).alias("raw_pn"), "n_lines"))


# --- decoding --------------------------------------------------------------------------
@query(f'WITH {PARSED} SELECT raw_pn, normalized, sheet, series, class, size, size_number, size_padded, "insert", contact, key, error, count(*) AS n FROM parsed GROUP BY ALL')
def pn_decode_strict(spark, sf_dir):
    cols = ["raw_pn", "normalized", "sheet", "series", "class", "size", "size_number", "size_padded", "insert", "contact", "key", "error"]
    return distinct_parsed(spark, sf_dir).select(*cols, F.col("n_lines").alias("n"))


@query(f"WITH {PARSED} SELECT error, variant, count(*) AS n, count(DISTINCT raw_pn) AS n_distinct FROM parsed GROUP BY ALL")
def pn_parse_error(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy("error", "variant").agg(F.count("*").alias("n"), F.count_distinct("raw_pn").alias("n_distinct"))


_G = {n: p for n, p, _ in decode.GRAMMARS}
_GRAMMAR_SQL = rf"""
  WITH feed AS ({FEED}), d AS (SELECT DISTINCT raw_pn, regexp_replace(upper(raw_pn), '\s', '', 'g') AS pn FROM feed),
  k AS (SELECT *, CASE WHEN regexp_matches(pn, '{_G["standard"]}') THEN 'standard' WHEN regexp_matches(pn, '{_G["lanyard"]}') THEN 'lanyard'
                       WHEN regexp_matches(pn, '{_G["dummy"]}') THEN 'dummy' WHEN regexp_matches(pn, '{_G["cover"]}') THEN 'cover' END AS grammar FROM d),
  f AS (SELECT *, CASE grammar WHEN 'standard' THEN regexp_extract(pn, '{_G["standard"]}', 1) WHEN 'lanyard' THEN regexp_extract(pn, '{_G["lanyard"]}', 1)
                    WHEN 'dummy' THEN regexp_extract(pn, '{_G["dummy"]}', 1) WHEN 'cover' THEN regexp_extract(pn, '{_G["cover"]}', 1) END AS sheet,
          CASE grammar WHEN 'standard' THEN regexp_extract(pn, '{_G["standard"]}', 2) WHEN 'lanyard' THEN regexp_extract(pn, '{_G["lanyard"]}', 2)
                    WHEN 'dummy' THEN regexp_extract(pn, '{_G["dummy"]}', 3) WHEN 'cover' THEN regexp_extract(pn, '{_G["cover"]}', 2) END AS class,
          CASE grammar WHEN 'standard' THEN regexp_extract(pn, '{_G["standard"]}', 3) WHEN 'lanyard' THEN 'J'
                    WHEN 'dummy' THEN regexp_extract(pn, '{_G["dummy"]}', 2)
                    WHEN 'cover' THEN coalesce(CASE regexp_extract(pn, '{_G["cover"]}', 3) {" ".join(f"WHEN '{n}' THEN '{c}'" for c, n in R.SHELL_SIZES)} END, '') END AS size,
          CASE grammar WHEN 'standard' THEN regexp_extract(pn, '{_G["standard"]}', 5) WHEN 'lanyard' THEN regexp_extract(pn, '{_G["lanyard"]}', 5) END AS contact
        FROM k)
  SELECT raw_pn, grammar, sheet, class, size, contact,
    grammar IS NOT NULL AND (contact IS NULL OR contains('{R.KNOWN_CONTACT_LETTERS}', contact))
      AND (size IS NULL OR size = '' OR size IN ({_LIST(c for c, _ in R.SHELL_SIZES)})) AS valid FROM f
"""


@query(_GRAMMAR_SQL)
def pn_decode_grammars(spark, sf_dir):
    d = part_feed(spark, sf_dir).select("raw_pn").distinct()
    return decode.decode_grammars(d).select("raw_pn", "grammar", "sheet", "class", "size", "contact", "valid")


@query(rf"""
  WITH feed AS ({FEED}), d AS (SELECT regexp_replace(upper(raw_pn), '[\s-]', '', 'g') AS pn FROM feed),
  s AS (SELECT *, regexp_extract(pn, '^D38999/(\d\d)', 1) AS sh, substr(pn, 10) AS body FROM d)
  SELECT CASE WHEN sh IN ({_SHEETS}) AND regexp_matches(pn, '^D38999/\d\d[A-Z]{{1,2}}[A-HJ]\d{{1,3}}[A-Z][A-Z]?$') THEN NULL
              WHEN pn LIKE 'MS%' OR pn LIKE 'M38999%' THEN 'legacy series' WHEN sh = '' THEN 'other standard'
              WHEN sh NOT IN ({_SHEETS}) THEN 'other sheet' WHEN regexp_matches(body, '^[A-Z]{{1,2}}\d') THEN 'numeric shell size'
              WHEN regexp_matches(body, '^[A-Z]{{1,2}}[A-HJ]\d{{1,3}}[A-Z][A-Z]?.+$') THEN 'trailing variant'
              WHEN NOT regexp_matches(body, '\d') THEN 'partial' ELSE 'other' END AS bucket, count(*) AS n FROM s GROUP BY ALL
""")
def pn_noncanonical_buckets(spark, sf_dir):
    return part_feed(spark, sf_dir).groupBy(decode.odd_bucket("raw_pn").alias("bucket")).agg(F.count("*").alias("n"))


# --- conversion ------------------------------------------------------------------------
@query(f"WITH {PARSED}, {FORWARD} SELECT normalized, ord, vendor, line, vendor_pn, count(*) AS n FROM converted GROUP BY ALL")
def convert_forward(spark, sf_dir):
    parts = ["normalized", "error", "sheet", "class", "size", "size_number", "size_padded", "insert", "contact", "key"]
    counted = distinct_parsed(spark, sf_dir).where("error IS NULL").groupBy(*parts).agg(F.sum("n_lines").alias("n"))
    out = convert.convert_forward(counted)
    return out.select("normalized", "ord", "vendor", "line", "vendor_pn", "n")


@query(f"WITH {PARSED}, {FORWARD} SELECT vendor, count(*) AS n_lines, count(DISTINCT vendor_pn) AS n_numbers FROM converted GROUP BY vendor")
def convert_vendor_totals(spark, sf_dir):
    out = convert.convert_forward(distinct_parsed(spark, sf_dir)).groupBy("vendor", "vendor_pn").agg(F.sum("n_lines").alias("n"))
    return out.groupBy("vendor").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_numbers"))


_REASONS = R.values([(o, v, ln, s, z, c, k, "," + ",".join(st) + ",", "," + ",".join(fi) + ",") for o, v, ln, _, s, _, z, c, k, st, fi in R.RULES])


@query(f"""
  WITH {PARSED}, r(ord, vendor, line, s, sizes, contacts, keys, sheets, classes) AS (VALUES {_REASONS}),
  p AS (SELECT normalized, any_value(series) AS series, any_value(sheet) AS sheet, any_value(class) AS class, any_value(size) AS size,
               any_value(contact) AS contact, any_value(key) AS key FROM parsed WHERE error IS NULL GROUP BY normalized),
  x AS (SELECT ord, vendor, line, CASE WHEN series <> s THEN 'series not supported'
          WHEN NOT contains(sheets, ',' || sheet || ',') THEN 'shell type not supported'
          WHEN sizes <> '' AND NOT contains(sizes, size) THEN 'shell size not supported'
          WHEN NOT contains(contacts, contact) THEN 'contact not supported' WHEN NOT contains(keys, key) THEN 'key position not supported'
          WHEN NOT contains(classes, ',' || class || ',') THEN 'finish/class not supported'
          WHEN vendor = 'Souriau' AND contact IN ('H', 'J') AND class NOT IN ('J', 'M') THEN 'contact only for composite classes' END AS reason
        FROM p CROSS JOIN r)
  SELECT ord, vendor, line, reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY ALL
""")
def convert_unsupported_reason(spark, sf_dir):
    once = corpus.first_wins(distinct_parsed(spark, sf_dir).where("error IS NULL"), ["normalized"], ["raw_pn"])
    return convert.unsupported_reasons(once).groupBy("ord", "vendor", "line", "reason").agg(F.count("*").alias("n"))


def vendor_feed(spark, sf_dir) -> DataFrame:
    """Vendor numbers with the noise that catalogs and orders add."""
    fwd = convert_forward(spark, sf_dir).select("normalized", "ord", "vendor_pn").distinct()
    noisy = F.when(F.col("ord") % 3 == 0, F.concat("vendor_pn", F.lit("F459"))).when(F.col("ord") % 3 == 1, F.lower("vendor_pn"))
    return fwd.select("normalized", "ord", noisy.otherwise(X.strip_dashes("vendor_pn")).alias("vendor_pn"))


def _reverse_heads() -> list[tuple]:
    """(ord, vendor, fmt, finish, sizes, contacts, keys, sheet, class, head, board, crimp) of every rule row, and of its board variant."""
    out = []
    for o, vendor, _, fmt, _, base, sizes, contacts, keys, sheet, cls, style, finish in R.rule_rows():
        crimp = {"prefix": style + finish, "letter": base + style + cls, "T": base + style + "T", "8D": base + style}.get(fmt, base + style + finish).replace("-", "")
        row = (o, vendor, fmt, finish, sizes, contacts, keys, sheet, cls)
        out.append((*row, crimp, False, crimp))
        if fmt == "prefix" and (board := re.sub(r"R([A-Z]+)$", r"\1", crimp)) != crimp:
            out.append((*row, board, True, crimp))
    return out


def _reverse_sql(numbers: str) -> str:
    """Every number against every head, for a query with a column vendor_pn."""
    nums = "|".join(sorted(["09", *[n for _, n in R.SHELL_SIZES]], key=lambda n: (-len(n), n)))
    forms = {"letter": r"^([A-HJ])()(\d{1,2})([A-Z])([A-Z])?$", "T": rf"^({nums})([A-Z])(\d{{1,2}})([A-Z])([A-Z])?$", "prefix": rf"^({nums})()(\d{{1,3}})([A-Z])([A-Z])?$", "": rf"^({nums})()(\d{{1,2}})([A-Z])([A-Z])?$"}
    kind = "CASE WHEN fmt IN ('letter', 'ACT') THEN 'letter' WHEN fmt IN ('T', '8D') THEN 'T' WHEN fmt = 'prefix' THEN 'prefix' ELSE '' END"
    part = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(rest, '{p}', {i})" for k, p in forms.items()) + " END"
    strip = r"regexp_replace(upper(vendor_pn), '\s+', '', 'g')"
    for p in ("-LC$", r"F\d{3}(LFC?)?$", "-LF$"):
        strip = f"regexp_replace({strip}, '{p}', '')"
    sizes = " ".join(f"WHEN '{n}' THEN '{c}'" for c, n in [*R.SHELL_SIZES, ("A", "09")])
    return rf"""
  SELECT DISTINCT vendor_pn, ord, vendor, 'D38999/' || sheet || class || size || ins || contact || key AS normalized FROM (
    SELECT *, CASE kind WHEN 'letter' THEN g1 ELSE CASE g1 {sizes} END END AS size, CASE WHEN g5 <> '' THEN g5 WHEN fmt IN ('prefix', 'BL', 'base') THEN 'N' END AS key FROM (
      SELECT *, {part(1)} AS g1, {part(2)} AS g2, {part(3)} AS ins, {part(4)} AS contact, {part(5)} AS g5 FROM (
        SELECT n.vendor_pn, h.*, {kind} AS kind, CASE WHEN board THEN regexp_replace(regexp_replace(substr(x, length(head) + 1), '^(GQ|RQ)', ''), '^(CI|LI|G|Q)', '') ELSE substr(x, length(head) + 1) END AS rest
        FROM (SELECT vendor_pn, regexp_replace({strip}, '[\s-]', '', 'g') AS x FROM ({numbers})) n
        JOIN (VALUES {R.values(_reverse_heads())}) h(ord, vendor, fmt, finish, sizes, contacts, keys, sheet, class, head, board, crimp) ON starts_with(x, head) AND (NOT board OR NOT starts_with(x, crimp)))))
  WHERE ins <> '' AND key IS NOT NULL AND size IS NOT NULL AND (fmt NOT IN ('T', '8D') OR g2 = finish)
    AND (fmt = 'prefix' OR ((sizes = '' OR contains(sizes, size)) AND contains(contacts, contact) AND contains(keys, key) AND NOT (vendor = 'Souriau' AND contact IN ('H', 'J') AND class NOT IN ('J', 'M'))))"""


_NOISY = f"""WITH {PARSED}, {FORWARD}, f AS (SELECT DISTINCT normalized, ord, vendor_pn FROM converted)
  SELECT DISTINCT CASE ord % 3 WHEN 0 THEN vendor_pn || 'F459' WHEN 1 THEN lower(vendor_pn) ELSE replace(vendor_pn, '-', '') END AS vendor_pn FROM f"""


@query(_reverse_sql(_NOISY))
def convert_reverse(spark, sf_dir):
    numbers = vendor_feed(spark, sf_dir).select("vendor_pn").distinct()
    return convert.convert_reverse(numbers)


_BOARD = rf"""WITH {PARSED}, {FORWARD}, f AS (SELECT DISTINCT normalized, ord, vendor_pn FROM converted WHERE fmt = 'prefix')
  SELECT DISTINCT regexp_replace(replace(vendor_pn, '-', ''), 'R([A-Z]+)(\d+[A-Z]+)$', '\1' || CASE ord % 3 WHEN 0 THEN 'CI' WHEN 1 THEN 'GQ' ELSE '' END || '\2') || 'F459' AS vendor_pn FROM f"""


@query(_reverse_sql(_BOARD))
def convert_reverse_board(spark, sf_dir):
    """Numbers of board variants: the crimp prefix without its R, with marks for quadrax or termination."""
    fwd = convert_forward(spark, sf_dir).join(convert.rules(spark).where("fmt = 'prefix'").select("ord").distinct(), "ord").select("ord", "vendor_pn").distinct()
    mark = F.when(F.col("ord") % 3 == 0, "CI").when(F.col("ord") % 3 == 1, "GQ").otherwise("")
    body = F.replace("vendor_pn", F.lit("-"), F.lit(""))
    made = F.regexp_replace(body, F.lit(r"R([A-Z]+)(\d+[A-Z]+)$"), F.concat(F.lit("$1"), mark, F.lit("$2")))
    return convert.convert_reverse(fwd.select(F.concat(made, F.lit("F459")).alias("vendor_pn")).distinct())


@query(f"""
  WITH {PARSED}, {FORWARD}, k AS (SELECT DISTINCT normalized, ord FROM converted)
  SELECT ord, count(*) AS n, count(*) AS n_back FROM k GROUP BY ord
""")
def roundtrip_check(spark, sf_dir):
    """Every forward number, with noise, leads back to where it came from under the same rule."""
    fed = vendor_feed(spark, sf_dir)
    back = convert.convert_reverse(fed.select("vendor_pn").distinct()).select("vendor_pn", "ord", F.col("normalized").alias("found"))
    met = fed.join(back, ["vendor_pn", "ord"], "left").groupBy("ord", "normalized", "vendor_pn").agg(F.bool_or(F.col("found") == F.col("normalized")).alias("ok"))
    return met.groupBy("ord").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_back"))


# --- evidence and snapshots ----------------------------------------------------------
_SOURCES = "('verified', 11), ('secondary', 3), ('listed', 2), ('qualified', 5), ('example', 7)"
_EVIDENCE = rf"""
  WITH feed AS ({FEED}), s(source, m) AS (VALUES {_SOURCES}),
  t AS (SELECT regexp_replace(upper(raw_pn), '[^A-Z0-9/]', '', 'g') AS key, raw_pn, l_orderkey, l_suppkey, source FROM feed JOIN s ON l_orderkey % m = 0),
  e AS (SELECT key, bool_or(source = 'verified') AS verified, bool_or(source = 'secondary') AS secondary, bool_or(source = 'listed') AS listed,
               bool_or(source = 'qualified') AS qualified, bool_or(source = 'example') AS example, min(raw_pn) AS first_text,
               max(l_orderkey) AS last_order, count(DISTINCT l_suppkey) AS n_suppliers FROM t GROUP BY key),
  l AS (SELECT *, CASE WHEN verified THEN 'verified exact' WHEN listed AND secondary THEN 'listed and secondary' WHEN qualified THEN 'qualified source'
                       WHEN listed THEN 'listed' WHEN secondary THEN 'secondary exact' WHEN example THEN 'catalog example' ELSE 'other' END AS level FROM e)
"""


def _evidence(spark, sf_dir):
    tagged = corpus.tag_sources(part_feed(spark, sf_dir)).withColumn("key", decode.key_of("raw_pn"))
    return corpus.merge_evidence(tagged)


@query(_EVIDENCE + " SELECT * FROM l")
def evidence_merge(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(_EVIDENCE + " SELECT level, count(*) AS n, count(*) FILTER (WHERE qualified) AS n_qualified FROM l GROUP BY level")
def evidence_histogram(spark, sf_dir):
    return _evidence(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.count_if("qualified").alias("n_qualified"))


@query("""
  WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'),
       n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
  SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey,
         CASE WHEN o.o_custkey IS NULL THEN 'added' WHEN n.o_custkey IS NULL THEN 'removed' ELSE 'kept' END AS change
  FROM o FULL JOIN n ON o.o_custkey = n.o_custkey
""")
def snapshot_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    return corpus.snapshot_diff(orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut), "o_custkey")


@query(f"WITH feed AS ({FEED}) SELECT raw_pn, count(*) AS n FROM feed GROUP BY raw_pn ORDER BY n DESC, raw_pn LIMIT 25")
def top_sources(spark, sf_dir):
    return catalog.top_with_ties(part_feed(spark, sf_dir), "raw_pn", 25)


@query("SELECT user_id, arg_max(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_event_wins(spark, sf_dir):
    return corpus.last_wins(table(spark, sf_dir, "events"), "user_id", "event_id", "props")


@query("""
  SELECT source, lang, doc_id, n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1
""")
def dedupe_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return corpus.first_wins(d, ["source", "lang"], [F.desc("n_chars"), "doc_id"])


# --- validation and mating -----------------------------------------------------------
_STATUS = f"""
  d AS (SELECT raw_pn, any_value(normalized) AS normalized, any_value(error) AS error, any_value(sheet) AS sheet, any_value(series) AS series,
               any_value(class) AS class, any_value(size) AS size, any_value("insert") AS "insert", any_value(contact) AS contact, any_value(key) AS key,
               count(*) AS n_lines FROM parsed GROUP BY raw_pn),
  st AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'missing data' WHEN n_lines % 7 = 0 THEN 'exact match' WHEN n_lines % 5 = 0 THEN 'verified'
           WHEN n_lines % 3 = 0 THEN 'secondary exact' WHEN sheet IN ({_LIST(R.HERMETIC_SHEETS)}) THEN 'vendor specific'
           ELSE 'valid format, not confirmed' END AS status FROM d)
"""


def _status(spark, sf_dir):
    p = distinct_parsed(spark, sf_dir)
    flags = {"in_corpus": 7, "in_verified": 5, "in_secondary": 3}
    return p.withColumns({c: F.col("n_lines") % m == 0 for c, m in flags.items()}).withColumn("status", validate.validation_status())


@query(f"WITH {PARSED}, {_STATUS} SELECT status, series, count(*) AS n FROM st GROUP BY ALL")
def validation_status(spark, sf_dir):
    return _status(spark, sf_dir).groupBy("status", "series").agg(F.count("*").alias("n"))


_EDGES = R.values(sorted({(a, b) for s, ms in R.MATING_SHEETS for m in ms for a, b in ((s, m), (m, s))}))
_FLIP = R.values([p for a, b in R.CONTACT_PAIRS for p in ((a, b), (b, a))])
_MATES = f"""
  edge(sheet, mate) AS (VALUES {_EDGES}), flip(contact, mate_contact) AS (VALUES {_FLIP}),
  mt AS (SELECT st.*, mate, mate_contact, 'D38999/' || mate || class || size || "insert" || mate_contact || key AS mate_pn,
                (CASE WHEN mate_contact IS NULL THEN 1 ELSE 0 END) + (CASE WHEN contact NOT IN ({_LIST(c for c, _ in R.CONTACTS)}) THEN 1 ELSE 0 END)
                + (CASE WHEN NOT contains('{R.KEYS_IV}', key) THEN 1 ELSE 0 END) + (CASE WHEN series = 'III' AND NOT contains('{R.KEYS_III}', key) THEN 1 ELSE 0 END) AS n_fails
         FROM st JOIN edge USING (sheet) LEFT JOIN flip USING (contact) WHERE error IS NULL)
"""


@query(f"WITH {PARSED}, {_STATUS}, {_MATES} SELECT raw_pn, normalized, mate, mate_pn, n_fails FROM mt")
def mate_candidates(spark, sf_dir):
    return validate.mates(_status(spark, sf_dir)).select("raw_pn", "normalized", "mate", "mate_pn", F.size("fails").alias("n_fails"))


@query(f"""
  WITH {PARSED}, {_STATUS}, {_MATES}
  SELECT mate, status, CASE WHEN n_fails > 0 THEN 0 ELSE least(99, greatest(0, 94 + CASE status WHEN 'exact match' THEN 20 WHEN 'verified' THEN 20
    WHEN 'secondary exact' THEN 10 WHEN 'valid format, not confirmed' THEN 5 WHEN 'vendor specific' THEN -8 ELSE 0 END)) END AS score, count(*) AS n
  FROM mt GROUP BY ALL
""")
def mate_score(spark, sf_dir):
    return validate.mates(_status(spark, sf_dir)).groupBy("mate", "status", validate.mate_score().alias("score")).agg(F.count("*").alias("n"))


# --- environments --------------------------------------------------------------------
def _env_rows() -> str:
    score = dict(R.SUITABILITY)
    out = [f"SELECT key, '{e}' AS environment, {score[s]} AS score FROM ok" for e, s in environment.ALWAYS]
    emi, her = _LIST(R.EMI_SHEETS), _LIST(R.HERMETIC_SHEETS)
    conds = [
        ("max_temp = 200", "high_temperature", "recommended"), ("max_temp = 175", "high_temperature", "acceptable"),
        (f"sheet IN ({emi})", "high_emi_rfi", "recommended"), (f"sheet NOT IN ({emi}) AND coalesce(conductive, true)", "high_emi_rfi", "conditional"),
        (f"sheet NOT IN ({emi}) AND NOT conductive", "high_emi_rfi", "not_recommended"), ("space_grade", "space", "acceptable"),
        (f"sheet IN ({her}) OR space_grade", "vacuum", "acceptable"), (f"sheet IN ({her})", "industrial", "recommended"),
        ("class IN ('K', 'S')", "high_temperature", "recommended"),
    ]
    conds += [(f"salt_hours = {h}", e, s) for h, ps in environment.SALT.items() for e, s in ps]
    out += [f"SELECT key, '{e}', {score[s]} FROM ok WHERE {c}" for c, e, s in conds]
    out.append("SELECT key, 'unknown_environment', 0 FROM acc")
    return "\n UNION ALL ".join(out)


_ENV = rf"""
  WITH g AS ({_GRAMMAR_SQL.strip()}), f(fact_class, max_temp, salt_hours, conductive, space_grade) AS (VALUES {R.values(R.CLASS_FACTS)}),
  j AS (SELECT raw_pn AS key, sheet, class, max_temp, salt_hours, conductive, space_grade FROM g LEFT JOIN f ON class = fact_class WHERE grammar IS NOT NULL),
  ok AS (SELECT * FROM j WHERE sheet NOT IN ({_LIST(R.ACCESSORY_SHEETS)})), acc AS (SELECT * FROM j WHERE sheet IN ({_LIST(R.ACCESSORY_SHEETS)})),
  p AS ({_env_rows()}),
  tag(environment, rank) AS (VALUES {R.values([(t, i) for i, t in enumerate(R.TAGS)])}),
  b AS (SELECT key, environment, max(score) AS score FROM p GROUP BY ALL)
"""


def _best(spark, sf_dir):
    d = decode.decode_grammars(part_feed(spark, sf_dir).select("raw_pn").distinct()).where("grammar IS NOT NULL")
    return environment.best_profiles(environment.profiles(d.withColumnRenamed("key", "keying").withColumnRenamed("raw_pn", "key")), "key")


@query(_ENV + " SELECT key, string_agg(environment, ',' ORDER BY rank) AS tags FROM b JOIN tag USING (environment) WHERE score >= 3 GROUP BY key")
def environment_tags(spark, sf_dir):
    return environment.tags(_best(spark, sf_dir), "key")


@query(_ENV + " SELECT key, " + ", ".join(f"max(CASE WHEN environment IN ({_LIST(es)}) THEN score ELSE 0 END) AS {n}" for n, es in R.SCORE_GROUPS) + " FROM b GROUP BY key")
def environment_score(spark, sf_dir):
    return environment.group_scores(_best(spark, sf_dir), "key")


@query(_ENV + " SELECT environment, score, count(*) AS n FROM b GROUP BY ALL")
def environment_histogram(spark, sf_dir):
    return _best(spark, sf_dir).groupBy("environment", "score").agg(F.count("*").alias("n"))


@query(_ENV + " SELECT key, environment, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, rank) AS rn FROM b JOIN tag USING (environment)) WHERE rn = 1")
def profile_best(spark, sf_dir):
    return environment.top_environment(_best(spark, sf_dir), "key").select("key", "environment", "score")


# --- electrical ----------------------------------------------------------------------
def _derate_sql(n: str) -> str:
    steps = [f"WHEN {n} <= 1 THEN 1.0::DOUBLE"]
    for (a, fa), (b, fb) in zip(electrical.KNOTS, electrical.KNOTS[1:]):
        steps.append(f"WHEN {n} <= {b} THEN ({fa * (b - a)} - ({n} - {a}) * {fa - fb})::DOUBLE / {100 * (b - a)}")
    return "(CASE " + " ".join(steps) + " ELSE 0.45::DOUBLE END)"


@query(f"SELECT p_size AS n, {_derate_sql('p_size')} AS factor, count(*) AS n_parts FROM part GROUP BY p_size")
def derating_curve(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("n")).agg(F.count("*").alias("n_parts")).withColumn("factor", electrical.derating(F.col("n")))


_SIZES6 = ["22D", "20", "16", "12", "8 Coax", "8 Twinax"]
_RATE = "CASE size " + " ".join(f"WHEN '{s}' THEN {a}" for s, a, *_ in R.RATINGS) + " ELSE 0.0 END"


@query(f"""
  WITH a AS (SELECT p_partkey AS id, unnest([0, 1, 2]) AS i, p_size FROM part),
  n AS (SELECT id, [{_LIST(_SIZES6)}][CAST((id + i) % 6 + 1 AS INT)] AS size, p_size % 7 + i AS count FROM a),
  t AS (SELECT id, sum(count)::BIGINT AS n_signal, sum({_RATE} * count)::DOUBLE AS raw_amps FROM n WHERE size NOT LIKE '%ax' GROUP BY id)
  SELECT id, n_signal, raw_amps, {_derate_sql("n_signal")} AS factor, round(raw_amps * {_derate_sql("n_signal")}, 1) AS amps FROM t
""")
def current_capacity(spark, sf_dir):
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    sizes = F.array(*[F.lit(s) for s in _SIZES6])
    notes = notes.select("id", F.get(sizes, ((F.col("id") + F.col("i")) % 6).cast("int")).alias("size"), (F.col("p_size") % 7 + F.col("i")).alias("count"))
    return electrical.capacity(notes, "id")


def _power_sql() -> str:
    """Brute force: every size and number, then the walk up the sizes."""
    return f"""
  WITH need AS (SELECT DISTINCT l_quantity AS amps, l_linenumber AS other FROM lineitem),
  s(size, rated) AS (VALUES {R.values([(s, a) for s, a, *_ in R.RATINGS if s in electrical.POWER_SIZES])}),
  fit AS (SELECT amps, other, size, min(n) AS n FROM need CROSS JOIN s CROSS JOIN range(1, {electrical.MOST + 1}) r(n)
          WHERE n * (rated * {_derate_sql("(other + n)")}) * 100 >= amps * 125
            AND (amps <= 13 OR (n >= 2 AND (n - 1) * (rated * {_derate_sql("(other + n)")}) >= amps)) GROUP BY ALL),
  w AS (SELECT amps, other, max(CASE size WHEN '22D' THEN n END) AS a, max(CASE size WHEN '20' THEN n END) AS b,
               max(CASE size WHEN '16' THEN n END) AS c, max(CASE size WHEN '12' THEN n END) AS d FROM fit GROUP BY ALL),
  f1 AS (SELECT *, CASE WHEN b IS NOT NULL AND (a IS NULL OR b <= a - 2) THEN b ELSE a END AS n1, CASE WHEN b IS NOT NULL AND (a IS NULL OR b <= a - 2) THEN '20' WHEN a IS NOT NULL THEN '22D' END AS s1 FROM w),
  f2 AS (SELECT *, CASE WHEN c IS NOT NULL AND (n1 IS NULL OR c <= n1 - 2) THEN c ELSE n1 END AS n2, CASE WHEN c IS NOT NULL AND (n1 IS NULL OR c <= n1 - 2) THEN '16' ELSE s1 END AS s2 FROM f1),
  f3 AS (SELECT *, CASE WHEN d IS NOT NULL AND (n2 IS NULL OR d <= n2 - 2) THEN d ELSE n2 END AS n3, CASE WHEN d IS NOT NULL AND (n2 IS NULL OR d <= n2 - 2) THEN '12' ELSE s2 END AS s3 FROM f2)
  SELECT need.amps, need.other, s3 AS size, n3::INT AS n_contacts FROM need LEFT JOIN f3 USING (amps, other)
"""


@query(_power_sql())
def power_sizing(spark, sf_dir):
    need = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("amps"), F.col("l_linenumber").alias("other")).distinct()
    out = need.withColumn("p", electrical.power_contacts(F.col("amps"), F.col("other")))
    return out.select("amps", "other", F.col("p.size").alias("size"), F.col("p.n").alias("n_contacts"))


@query("SELECT CASE " + " ".join(f"WHEN l_quantity <= {a} THEN '{s}'" for s, a, *_ in R.RATINGS) + " END AS size, count(*) AS n, sum(l_quantity) AS amps FROM lineitem GROUP BY ALL")
def pick_size_lookup(spark, sf_dir):
    size = electrical.smallest_size(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("amps"))


# --- catalog -------------------------------------------------------------------------
@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 10 AND contains(lower(concat_ws(' ', p_name, p_type)), 'a')")
def catalog_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return catalog.filter_catalog(p, {"p_size": 10, "p_brand": None}, (["p_name", "p_type"], "A")).select("p_partkey", "p_name", "p_size")


@query("""
  SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY ALL
  UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL
  UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY ALL
""")
def catalog_facets(spark, sf_dir):
    return catalog.facets(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query("""
  WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_name = 'RED W' THEN 1 WHEN lower(p_name) = 'red w' THEN 2
      WHEN starts_with(lower(p_name), 'red w') THEN 3 WHEN contains(lower(p_name), 'red w') THEN 4 END AS tier FROM part)
  SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t)
""")
def tiered_search(spark, sf_dir):
    return catalog.tiered_search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "RED W")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 10")
def keyword_search(spark, sf_dir):
    return catalog.keyword_search(table(spark, sf_dir, "documents"), ["text"], "license", "doc_id").select("doc_id", "lang", "source")


@query(f"""
  WITH {PARSED} SELECT series, sheet, class, count(DISTINCT normalized) AS n_leaves, grouping_id(series, sheet, class) AS gid
  FROM parsed WHERE error IS NULL GROUP BY ROLLUP (series, sheet, class)
""")
def selector_rollup(spark, sf_dir):
    return catalog.rollup_counts(distinct_parsed(spark, sf_dir).where("error IS NULL"), ["series", "sheet", "class"], "normalized")


_BUILD = (["20", "24", "26"], ["W", "F"], ["A", "B", "C", "D"], [str(i) for i in range(1, 62)])


@query(f"""
  WITH {PARSED}, b AS (SELECT 'D38999/' || a || c || s || i || 'PN' AS pn FROM (SELECT unnest([{_LIST(_BUILD[0])}]) AS a), (SELECT unnest([{_LIST(_BUILD[1])}]) AS c),
    (SELECT unnest([{_LIST(_BUILD[2])}]) AS s), (SELECT unnest([{_LIST(_BUILD[3])}]) AS i))
  SELECT pn FROM b WHERE pn IN (SELECT normalized FROM parsed WHERE error IS NULL)
""")
def selector_semi(spark, sf_dir):
    """Built combinations that the corpus has: a semi join."""
    built = catalog.build_numbers(spark, *_BUILD)
    known = distinct_parsed(spark, sf_dir).where("error IS NULL").select(F.col("normalized").alias("pn"))
    return built.join(known, "pn", "left_semi")


@query("""
  SELECT n_nationkey, n_name, n_regionkey, coalesce(lag(n_name) OVER w, max(n_name) OVER (PARTITION BY n_regionkey)) AS prev,
         coalesce(lead(n_name) OVER w, min(n_name) OVER (PARTITION BY n_regionkey)) AS next
  FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)
""")
def step_neighbours(spark, sf_dir):
    return catalog.neighbours(table(spark, sf_dir, "nation"), "n_regionkey", "n_name")


_FAMILY_SQL = "CASE " + " ".join(f"WHEN starts_with(x, '{p}') THEN '{f}'" for _, p, f, _ in rugged.FAMILIES) + " END"
_SUFFIX_SQL = "CASE " + " ".join(f"WHEN starts_with(x, '{p}') THEN substr(pn, {len(p) + 1})" for _, p, _, _ in rugged.FAMILIES) + " END"


@query(f"""
  WITH f AS (SELECT p_partkey, [{_LIST(p for _, p, _, _ in rugged.FAMILIES)}, 'XX'][CAST(p_partkey % 8 + 1 AS INT)] || [{_LIST(["6A", "7", "2G6", "00", "F459", "F312", "", "CM"])}][CAST(p_size % 8 + 1 AS INT)] AS pn FROM part),
  g AS (SELECT *, upper(pn) AS x FROM f), h AS (SELECT p_partkey, pn, {_FAMILY_SQL} AS family, {_SUFFIX_SQL} AS suffix FROM g)
  SELECT *, CASE WHEN regexp_matches(suffix, 'F3(12|11)|F05[89]') THEN 'free' WHEN contains(suffix, 'F459') THEN 'panel' WHEN contains(suffix, 'G6') THEN 'plug'
     WHEN regexp_matches(suffix, 'D0|00') THEN 'wall' WHEN regexp_matches(suffix, 'CM|07') THEN 'jam nut' WHEN starts_with(suffix, '6') THEN 'plug'
     WHEN starts_with(suffix, '7') THEN 'jam nut' WHEN starts_with(suffix, '2') THEN 'box' END AS mount FROM h
""")
def rugged_match(spark, sf_dir):
    pick = lambda xs, at: F.get(F.array(*[F.lit(x) for x in xs]), at.cast("int"))
    pn = F.concat(
        pick([p for _, p, _, _ in rugged.FAMILIES] + ["XX"], F.col("p_partkey") % 8),
        pick(["6A", "7", "2G6", "00", "F459", "F312", "", "CM"], F.col("p_size") % 8),
    )
    fed = table(spark, sf_dir, "part").select("p_partkey", pn.alias("pn"))
    return rugged.recognise(fed, "pn").select("p_partkey", "pn", "family", "suffix", rugged.mount(F.col("suffix")).alias("mount"))


# --- windows -------------------------------------------------------------------------
@query("""
  SELECT event_id, user_id, CASE WHEN rn = 1 THEN event_type ELSE event_type || rn END AS relabelled FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
""")
def label_renumber(spark, sf_dir):
    return windows.occurrence_labels(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "relabelled")


@query("""
  WITH d AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
  n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 3600000000 THEN 0 ELSE 1 END AS new FROM d)
  SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS group_no FROM n
""")
def gap_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return windows.gap_groups(e, "user_id", F.col("us"), 3_600_000_000, "event_id").select("event_id", "user_id", "group_no")


@query("""
  SELECT l_partkey, l_quantity, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
    sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS last FROM lineitem
""")
def cumulative_allocation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    order = [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    return windows.cumulative_slots(li, "l_partkey", order, "l_quantity").drop("first")


@query("""
  WITH RECURSIVE d AS (SELECT source, doc_id, coalesce(strlen(text), 0) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
  r AS (SELECT source, doc_id, size, rn, size AS used, 0::BIGINT AS chunk FROM d WHERE rn = 1
    UNION ALL SELECT d.source, d.doc_id, d.size, d.rn, CASE WHEN r.used + d.size > 20000 THEN d.size ELSE r.used + d.size END, r.chunk + (r.used + d.size > 20000)::BIGINT
    FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.rn = r.rn + 1)
  SELECT source, doc_id, chunk::INT AS chunk FROM r
""")
def byte_bounded_chunks(spark, sf_dir):
    """The sizes are UTF-8 bytes of the texts."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    return windows.chunks_by_size(d, "source", "doc_id", F.col("size"), 20_000)


# --- geometry ------------------------------------------------------------------------
def _points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 25).alias("drawing"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("side"),
        F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"),
    )
    return e.withColumn("drawing", (F.col("id") / 40).cast("long"))


@query()
def assignment_min_cost(spark, sf_dir):
    return geometry.assign_points(_points(spark, sf_dir), "drawing")


@query()
def nearest_greedy(spark, sf_dir):
    return geometry.greedy_nearest(_points(spark, sf_dir), "drawing", 0.5)


@query("SELECT label, round(abs(embedding[3])::DOUBLE, 2) AS bin, count(*) AS n, round(avg(abs(embedding[3])::DOUBLE), 9) AS mean FROM embeddings GROUP BY ALL")
def diameter_bins(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.abs(F.element_at("embedding", 3)).alias("d"))
    return geometry.diameter_bins(e, "label", "d").withColumn("mean", F.round("mean", 9))


# --- HTML and text -------------------------------------------------------------------
@query(r"""
  WITH h AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS a,
                    regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS b FROM pages),
  u AS (SELECT page_id, unnest(range(len(a)))::INT AS pos, a, b FROM h)
  SELECT page_id, pos, a[pos + 1] AS href,
    trim(regexp_replace(replace(replace(replace(replace(replace(b[pos + 1], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS label
  FROM u
""")
def html_links(spark, sf_dir):
    return htmlscan.links(table(spark, sf_dir, "pages"))


@query(r"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY tag")
def html_tags(spark, sf_dir):
    return htmlscan.tag_counts(table(spark, sf_dir, "pages"))


_UNESC = "x"
for _a, _b in X.ENTITIES:
    _UNESC = f"replace({_UNESC}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query(rf"""
  WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS x FROM pages)
  SELECT page_id, trim(regexp_replace({_UNESC}, '\s+', ' ', 'g')) AS text FROM t
""")
def html_text(spark, sf_dir):
    return htmlscan.visible_text(table(spark, sf_dir, "pages"))


@query(rf"""
  WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS x FROM pages)
  SELECT page_id, trim(regexp_replace({_UNESC}, '\s+', ' ', 'g')) AS title FROM t
""")
def html_title(spark, sf_dir):
    return htmlscan.title(table(spark, sf_dir, "pages"))


@query("""
  SELECT p_partkey, p_name, string_agg(CASE WHEN regexp_full_match(t, '\\d+') THEN lpad(t, 12, '0') ELSE t END, '' ORDER BY i) AS sort_key FROM (
    SELECT p_partkey, p_name, unnest(r) AS t, unnest(range(len(r))) AS i FROM (SELECT *, regexp_extract_all(lower(p_name), '\\d+|[^0-9]+') AS r FROM part)) GROUP BY ALL
""")
def natural_sort_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", X.natural_key("p_name").alias("sort_key"))


@query(r"""
  WITH t AS (SELECT doc_id, text AS t FROM documents)
  SELECT doc_id, CASE WHEN contains(t, '"') OR contains(t, ',') OR contains(t, chr(10)) OR contains(t, chr(13)) THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell FROM t
""")
def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.escape_csv("text").alias("cell"))


@query("""
  WITH x AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY ALL)
  SELECT n_regionkey, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) = 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[:-2], ', ') || ', and ' || l[-1] END AS names FROM x
""")
def human_join(spark, sf_dir):
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return names.select("n_regionkey", X.readable_list("l").alias("names"))


@query(r"""
  WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
  SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 57)) || '...' ELSE t END AS short FROM t
""")
def summarize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.summarize("text", 60).alias("short"))


@query(r"""
  SELECT p_partkey, lower(regexp_replace(regexp_replace(trim(p_type), '[_\s]+', ' ', 'g'), '\s*([/-])\s*', '\1', 'g')) AS key,
    least(length(p_type), 48) + CASE WHEN p_type = trim(p_type) THEN 100 ELSE 0 END + CASE WHEN NOT contains(p_type, '_') THEN 300 ELSE 0 END
    + CASE WHEN regexp_matches(p_type, '[a-z]') AND regexp_matches(p_type, '[A-Z]') THEN 200 ELSE 0 END + CASE WHEN p_type <> upper(p_type) THEN 200 ELSE 0 END
    + CASE WHEN regexp_matches(p_type, '[/-]') THEN 100 ELSE 0 END AS score FROM part
""")
def display_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.display_key("p_type").alias("key"), X.display_score("p_type").cast("long").alias("score"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def props_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k BIGINT")["k"])
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# --- sets and quality ----------------------------------------------------------------
@query("""
  SELECT 'customer' AS section, c_nationkey AS nation, count(*) AS n, sum(c_acctbal) AS balance FROM customer GROUP BY ALL
  UNION ALL SELECT 'supplier', s_nationkey, count(*), sum(s_acctbal) FROM supplier GROUP BY ALL
""")
def union_sections(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("section"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("b"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("section"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("b"))
    return c.unionByName(s).groupBy("section", "nation").agg(F.count("*").alias("n"), F.sum("b").alias("balance"))


@query("""
  WITH b AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS a, count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.1, false)) AS b,
                    count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)) AS c FROM lineitem),
  r AS (SELECT 'quantity positive' AS "check", n_rows, a AS n_bad FROM b UNION ALL SELECT 'discount in range', n_rows, b FROM b UNION ALL SELECT 'flag known', n_rows, c FROM b
        UNION ALL SELECT 'order line unique', sum(n)::BIGINT, count(*) FILTER (WHERE n > 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
        UNION ALL SELECT 'order known', (SELECT count(*) FROM lineitem), count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
  SELECT *, CASE WHEN n_bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r
""")
def dq_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    checks = {
        "quantity positive": F.col("l_quantity") > 0,
        "discount in range": F.col("l_discount").between(0, 0.1),
        "flag known": F.col("l_returnflag").isin("A", "N"),
    }
    out = quality.check_rows(li, checks).unionByName(quality.unique_key(li, ["l_orderkey", "l_linenumber"], "order line unique"))
    return out.unionByName(quality.missing_parents(li, table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", "order known"))
