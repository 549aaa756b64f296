"""Queries on titles, grids, recent lists, invariants and the event stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators import decode, htmlscan, quality
from partlake.plans.queries import _ENV, _LIST, PARSED, _best, distinct_parsed, query, table
from partlake.streaming import dedupe

_DESCR = [d for _, d in R.SHEET_DESCRIPTIONS]
_SHEET = [s for s, _ in R.SHEET_DESCRIPTIONS]


@query(f"""
  WITH t AS (SELECT p_partkey, 'MIL-DTL-38999/' || [{_LIST(_SHEET)}][CAST(p_partkey % 17 + 1 AS INT)] || ' Connector, Series ' || CASE WHEN p_partkey % 17 < 7 THEN 'III' ELSE 'IV' END || ', '
      || [{_LIST(_DESCR)}][CAST(p_partkey % 17 + 1 AS INT)] || CASE WHEN p_size % 5 = 0 THEN ' (Initial Draft)' ELSE '' END AS title FROM part), l AS (SELECT *, lower(title) AS t FROM t)
  SELECT regexp_extract(title, '/(\\d+)', 1) AS sheet_no, CASE WHEN contains(t, 'series iv,') THEN 'IV' ELSE 'III' END AS series,
    CASE WHEN contains(t, 'plug') THEN 'plug' WHEN contains(t, 'receptacle') THEN 'receptacle' ELSE 'other' END AS component,
    CASE {" ".join(f"WHEN contains(t, '{n}') THEN '{v}'" for n, v in htmlscan.MOUNTS)} ELSE 'unknown' END AS mount, contains(t, 'initial draft') AS draft, count(*) AS n
  FROM l GROUP BY ALL
""")
def doc_classify(spark, sf_dir):
    at = (F.col("p_partkey") % 17).cast("int")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), at)
    title = F.concat(
        F.lit("MIL-DTL-38999/"), pick(_SHEET), F.lit(" Connector, Series "), F.when(at < 7, "III").otherwise("IV"), F.lit(", "), pick(_DESCR),
        F.when(F.col("p_size") % 5 == 0, " (Initial Draft)").otherwise(""),
    )
    out = htmlscan.classify_titles(table(spark, sf_dir, "part").select(title.alias("title")), "title")
    return out.groupBy("sheet_no", "series", "component", "mount", "draft").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS row, s_name AS Name, s_nationkey::VARCHAR AS Nation FROM supplier")
def html_grid(spark, sf_dir):
    cell = lambda f, c: F.concat(F.lit('<span id="g_ctl'), "s_suppkey", F.lit(f'_lbl{f}">'), F.col(c).cast("string"), F.lit("</span> "))
    page = table(spark, sf_dir, "supplier").select(F.concat(cell("Name", "s_name"), cell("Nation", "s_nationkey")).alias("html"))
    return htmlscan.grid_rows(page, "html", ["Name", "Nation"])


@query("""
  WITH l AS (SELECT user_id, event_type, max((ts, event_id)) AS last_at FROM events GROUP BY ALL)
  SELECT user_id, event_type, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC) AS place FROM l) WHERE place <= 3
""")
def recent_list(spark, sf_dir):
    """The last three different event types of each user, newest first: one aggregate, then a window over a few rows a user."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at")))
    return last.withColumn("place", place).where("place <= 3").select("user_id", "event_type", "place")


@query(_ENV + f"""
  , x AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE score NOT IN (0, 1, 3, 4, 5)) AS a, count(*) FILTER (WHERE environment NOT IN ({_LIST(R.TAGS)})) AS b FROM b)
  SELECT 'score known' AS "check", n_rows, a AS n_bad, CASE WHEN a = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM x
  UNION ALL SELECT 'environment known', n_rows, b, CASE WHEN b = 0 THEN 'PASS' ELSE 'FAIL' END FROM x
""")
def dq_environment(spark, sf_dir):
    checks = {"score known": F.col("score").isin([n for _, n in R.SUITABILITY]), "environment known": F.col("environment").isin(R.TAGS)}
    return quality.check_rows(_best(spark, sf_dir), checks)


@query(f"""
  WITH {PARSED}, d AS (SELECT DISTINCT normalized, contact FROM parsed WHERE error IS NULL)
  SELECT 'normalized parses to itself' AS "check", count(*) AS n_rows, 0::BIGINT AS n_bad, 'PASS' AS status FROM d
  UNION ALL SELECT 'contact documented', count(*), count(*) FILTER (WHERE NOT contains('{R.KNOWN_CONTACT_LETTERS}', contact)),
    CASE WHEN count(*) FILTER (WHERE NOT contains('{R.KNOWN_CONTACT_LETTERS}', contact)) = 0 THEN 'PASS' ELSE 'FAIL' END FROM d
""")
def dq_part_numbers(spark, sf_dir):
    d = distinct_parsed(spark, sf_dir).where("error IS NULL").groupBy(F.col("normalized").alias("first")).agg(F.max("normalized").alias("raw_pn"))
    again = decode.parse_strict(d)
    return quality.check_rows(
        again, {"normalized parses to itself": F.col("normalized") == F.col("first"), "contact documented": F.col("contact").isin(*R.KNOWN_CONTACT_LETTERS)}
    )


@query("SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def stream_dedupe(spark, sf_dir):
    """The event table as a file stream, each event id once, written by the stream's own sink and read back.

    The table is one file and so one micro-batch: no row is behind a watermark of an earlier one,
    and state is dropped an hour behind the latest event.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='partlake-stream-')}"
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = dedupe.read_events(spark, sf_dir, pattern="events.parquet")
    first = dedupe.first_events(events, "1 hour")
    sink = first.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    sink.awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))
