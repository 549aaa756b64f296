"""Queries on environment reports, drawings, forms in pages and composite orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions import text as X
from partlake.operators import decode, drawing, environment, htmlscan
from partlake.operators.ranking import numbered
from partlake.plans.labels import pick, pick_sql
from partlake.plans.queries import _ENV, _LIST, _best, query, table
from partlake.sources.feed import part_feed

_HER, _EMI, _ACC = _LIST(R.HERMETIC_SHEETS), _LIST(R.EMI_SHEETS), _LIST(R.ACCESSORY_SHEETS)


@query(_ENV + f"""
  , r AS (SELECT *, sheet IN ({_HER}) AS her FROM j)
  SELECT key, CASE WHEN sheet LIKE '4%' THEN 'IV' ELSE 'III' END AS series,
    CASE WHEN sheet IN ({_ACC}) THEN '' WHEN her THEN 'hermetic solder contacts|glass-to-metal seal barrier' ELSE 'environmentally sealed when wired, mated and fitted|altitude-immersion qualified in the mated condition' END AS sealing,
    CASE WHEN sheet IN ({_ACC}) THEN '' WHEN sheet IN ({_EMI}) THEN 'EMI grounding feature' WHEN coalesce(conductive, true) THEN 'conductive shell finish' ELSE 'nonconductive finish' END AS emi,
    CASE WHEN sheet NOT IN ({_ACC}) AND salt_hours > 0 THEN salt_hours || '-hour salt spray|' ELSE '' END || 'class ' || class || ' finish' AS corrosion,
    CASE WHEN sheet IN ({_ACC}) THEN '' ELSE '300 G half-sine shock|' || CASE WHEN sheet LIKE '4%' THEN 'breech coupling' ELSE 'threaded coupling' END END AS shock,
    CASE WHEN sheet IN ({_ACC}) THEN 0 WHEN her THEN 3 ELSE 5 END AS n_fluids,
    CASE WHEN sheet IN ({_ACC}) THEN '' ELSE concat_ws('|', CASE WHEN space_grade THEN 'space-grade finish' END, CASE WHEN her THEN 'glass-to-metal seal barrier' END) END AS vacuum FROM r
""")
def environment_features(spark, sf_dir):
    d = decode.decode_grammars(part_feed(spark, sf_dir).select("raw_pn").distinct()).where("grammar IS NOT NULL")
    out = environment.features(d)
    texts = [F.array_join(c, "|").alias(c) for c in ("sealing", "emi", "corrosion", "shock", "vacuum")]
    return out.select(F.col("raw_pn").alias("key"), environment.series_of(F.lit(None).cast("string"), "sheet").alias("series"), *texts, F.size("fluids").alias("n_fluids"))


_SCORES = ", ".join(f"max(CASE WHEN environment IN ({_LIST(es)}) THEN score ELSE 0 END) AS s_{n}" for n, es in R.SCORE_GROUPS)


@query(_ENV + f"""
  , s AS (SELECT key, {_SCORES}, max(score) FILTER (WHERE environment = 'vacuum') AS v, max(score) FILTER (WHERE environment = 'salt_fog') AS sf, bool_and(environment = 'unknown_environment') AS unknown FROM b GROUP BY key)
  SELECT key, CASE WHEN unknown THEN 'Accessory; environment was not classified.' ELSE concat_ws(' ', CASE WHEN s_air >= 4 THEN 'Suitable for aerospace service.' END, CASE WHEN s_land >= 4 THEN 'Matched to rugged land service.' END,
    CASE WHEN s_sea >= 4 THEN 'Finish supports salt-fog exposure.' WHEN s_sea = 3 THEN 'Marine use is conditional.' WHEN sf = 1 THEN 'Finish is weak in salt fog.' END,
    CASE WHEN s_industrial >= 4 THEN 'Industrial fluids are supported.' END, CASE WHEN s_space >= 4 THEN 'Space evidence is explicit.' WHEN v >= 3 THEN 'Vacuum is documented.' ELSE 'No space-grade evidence.' END) END AS notes FROM s
""")
def environment_notes(spark, sf_dir):
    best = _best(spark, sf_dir)
    return environment.notes(environment.group_scores(best, "key"), best, "key")


# --- drawings -----------------------------------------------------------------------------
def shapes(spark, sf_dir):
    e = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    v = F.col("vec_id")
    t = table(spark, sf_dir, "embeddings").select(
        F.floor(v / 20).alias("drawing"), v.alias("id"), F.round(e(1) * 100, 2).alias("x0"), F.round(e(2) * 100, 2).alias("y0"), (v % 30 + 1.0).alias("w"), (v % 7 == 0).alias("outline"), (v % 2 == 0).alias("stroked")
    )
    h = F.when(F.col("id") % 3 == 0, F.col("w")).otherwise(F.col("w") + 2)
    return t.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + h})


_SHAPES = """
  e AS (SELECT vec_id // 20 AS drawing, vec_id AS id, round(abs(embedding[1]::DOUBLE) * 100, 2) AS x0, round(abs(embedding[2]::DOUBLE) * 100, 2) AS y0, (vec_id % 30 + 1)::DOUBLE AS w, vec_id % 7 = 0 AS outline, vec_id % 2 = 0 AS stroked FROM embeddings),
  s AS (SELECT *, x0 + w AS x1, y0 + CASE WHEN id % 3 = 0 THEN w ELSE w + 2 END AS y1 FROM e)
"""


@query(f"WITH {_SHAPES} SELECT drawing, id FROM s WHERE stroked AND x1 - x0 BETWEEN 12 AND 100 AND abs((x1 - x0) - (y1 - y0)) <= 0.05 * (x1 - x0)")
def outline_candidates(spark, sf_dir):
    return drawing.outline_candidates(shapes(spark, sf_dir)).select("drawing", "id")


@query(f"""
  WITH {_SHAPES}, b AS (SELECT drawing, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, greatest(5.0, coalesce(max(x1 - x0) FILTER (WHERE outline), 0) * 0.12) AS pad FROM s GROUP BY drawing)
  SELECT drawing, greatest(0.0, x0 - pad)::DOUBLE AS x0, greatest(0.0, y0 - pad)::DOUBLE AS y0, least(100.0, x1 + pad)::DOUBLE AS x1, least(120.0, y1 + pad)::DOUBLE AS y1 FROM b
""")
def crop_boxes(spark, sf_dir):
    return drawing.crop(shapes(spark, sf_dir), "drawing", (100, 120))


@query(f"WITH {_SHAPES} SELECT drawing, id, row_number() OVER (PARTITION BY drawing ORDER BY y0, x0, id)::INT AS place FROM s")
def reading_order(spark, sf_dir):
    return drawing.reading_order(shapes(spark, sf_dir), "drawing", "y0", "x0", "id").select("drawing", "id", "place")


@query(f"""
  WITH {_SHAPES}, l AS (SELECT *, least(id % 4, 2.5)::DOUBLE AS dx FROM s)
  SELECT drawing, id FROM l WHERE id % 5 > 0 AND id % 3 = 0 AND dx >= 1.2 AND NOT (abs(dx / 2 - 1) <= 0.4 AND dx <= 2)
""")
def guide_lines(spark, sf_dir):
    """Each shape gives a level line and one contact beside its start."""
    dx = F.least(F.col("id") % 4, F.lit(2.5)).cast("double")
    t = shapes(spark, sf_dir).select(
        "drawing", "id", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), dx.alias("x2"), F.lit(0.0).alias("y2"), F.when(F.col("id") % 5 > 0, 0.5).otherwise(3.0).alias("width"),
        (F.col("id") % 3 == 0).alias("black"), F.array(F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("r"))).alias("contacts"),
    )
    return drawing.guide_lines(t, "contacts").select("drawing", "id")


@query("""
  WITH a AS (SELECT n_nationkey AS k, unnest([n_nationkey * 10, n_nationkey * 7 + 90]) AS angle FROM nation)
  SELECT k, angle, round(50 + 40 * cos(radians(angle)), 2) AS x1, round(50 + 40 * sin(radians(angle)), 2) AS y1, round(50 + 45 * cos(radians(angle)), 2) AS x2, round(50 + 45 * sin(radians(angle)), 2) AS y2 FROM a
""")
def key_lines(spark, sf_dir):
    k = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation").select(k.alias("k"), F.array(k * 10, k * 7 + 90).alias("angles"))
    return drawing.key_lines(t, "angles", 50.0, 50.0, 40.0, 45.0).drop("angles")


@query()
def merged_bins(spark, sf_dir):
    """Three bins a drawing at most, tested against plain Python."""
    s = shapes(spark, sf_dir).groupBy("drawing", F.round("w", 0).alias("bin")).agg(F.count("*").alias("n"))
    return drawing.merge_bins(s, "drawing", 3)


@query()
def point_clusters(spark, sf_dir):
    s = shapes(spark, sf_dir).select("drawing", "id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("w").alias("r"))
    return drawing.cluster_points(s, "drawing")


# --- forms and lists in pages ---------------------------------------------------------------
@query("""
  SELECT page_id AS id, {'state': 'v&' || page_id, 'kind': 'hidden'} AS x, page_id % 9 + 1 AS page, 10 AS pages, page_id * 1000 + 7 AS total,
    'D38999/26W' || page_id || 'PN' AS numbers FROM pages
""".replace("{'state': 'v&' || page_id, 'kind': 'hidden'} AS x", "'state=v&' || page_id || ',kind=hidden' AS fields"))
def form_fields(spark, sf_dir):
    i = F.col("page_id").cast("string")
    total = F.regexp_replace(F.format_number(F.col("page_id") * 1000 + 7, 0), r"\.$", "")
    html = F.concat(
        F.lit("<form><input type='hidden' name='state' value='v&amp;"), i, F.lit("'><input name=\"kind\" value=\"hidden\"><input type=submit name=go value=Go><p>Page "),
        (F.col("page_id") % 9 + 1).cast("string"), F.lit(" of 10, "), total, F.lit(" records</p><td>D38999/26W"), i, F.lit("PN</td></form>"),
    )
    return htmlscan.form_page(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), html.alias("html")), "id", "html")


@query("""
  WITH t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, CASE l_linenumber % 3 WHEN 1 THEN chr((65 + l_orderkey % 5)::INT) ELSE (l_partkey % 50)::VARCHAR || '.5' END AS line FROM lineitem),
  n AS (SELECT *, lead(line) OVER w AS a, lead(line, 2) OVER w AS b FROM t WINDOW w AS (PARTITION BY k ORDER BY i))
  SELECT k, line AS label, max_by(a::DOUBLE, i) AS x, max_by(b::DOUBLE, i) AS y FROM n WHERE regexp_full_match(line, '[A-Z]+') AND regexp_full_match(a, '\\d+\\.\\d+') AND regexp_full_match(b, '\\d+\\.\\d+') GROUP BY k, line
""")
def standard_table(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    line = F.when(F.col("l_linenumber") % 3 == 1, F.char(65 + F.col("l_orderkey") % 5)).otherwise(F.concat((F.col("l_partkey") % 50).cast("string"), F.lit(".5")))
    return htmlscan.table_triples(t.select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("i"), line.alias("line")), "k", "i", "line")


# --- composite orders -------------------------------------------------------------------------
@query(f"""
  WITH t AS (SELECT p_partkey, {pick_sql([c for c, _ in R.SHELL_SIZES], "p_size % 9")} AS code, p_partkey % 61 AS number, p_name FROM part)
  SELECT p_partkey, row_number() OVER (PARTITION BY code ORDER BY number, p_partkey)::INT AS in_shell,
    row_number() OVER (ORDER BY CASE code {" ".join(f"WHEN '{c}' THEN {n}" for c, n in R.SHELL_SIZES)} END, number, p_partkey)::INT AS place FROM t
""")
def arrangement_order(spark, sf_dir):
    """Shell by its size as a number, then the arrangement's number. A shell holds a ninth of all rows, so rows are numbered by ranges; the place over all is the shell's offset, from one row a shell, and the place in the shell."""
    k, s = F.col("p_partkey"), F.col("p_size")
    sizes = F.create_map(*[F.lit(x) for c, n in R.SHELL_SIZES for x in (c, int(n))])
    t = table(spark, sf_dir, "part").select(k, pick([c for c, _ in R.SHELL_SIZES], s % 9).alias("code"), (k % 61).alias("number"))
    t = t.withColumn("shell", F.try_element_at(sizes, F.col("code")))
    n = t.groupBy("shell").agg(F.count("*").alias("n"))
    before = n.select("shell", (F.sum("n").over(Window.orderBy("shell")) - F.col("n")).alias("before"))  # nine rows
    t = numbered(t, ["shell"], ["number", "p_partkey"], "in_shell")
    return t.join(F.broadcast(before), "shell").select("p_partkey", F.col("in_shell").cast("int").alias("in_shell"), (F.col("before") + F.col("in_shell")).cast("int").alias("place"))


@query("""
  WITH g AS (SELECT p_brand, list(DISTINCT p_size ORDER BY p_size) AS sizes, count(DISTINCT p_type) AS n_types FROM part GROUP BY p_brand)
  SELECT p_brand, array_to_string(sizes, ',') AS sizes, n_types FROM g
""")
def values_by_group(spark, sf_dir):
    """Different values of each group, shorter texts first, then by text: numbers in their order."""
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("s"), F.count_distinct("p_type").alias("n_types"))
    by_length = F.transform(F.array_sort(F.transform("s", lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))), lambda x: x["v"])
    return g.select("p_brand", F.array_join(by_length, ",").alias("sizes"), "n_types")


@query("SELECT DISTINCT trim(split_part(x, ' / ', 1)) AS name FROM (SELECT c_mktsegment || ' / ' || c_name AS x FROM customer UNION ALL SELECT s_name FROM supplier) WHERE trim(split_part(x, ' / ', 1)) <> 'MACHINERY'")
def union_names(spark, sf_dir):
    """Different names of two groups, the text before a slash, without an excluded one."""
    c = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(" / "), "c_name").alias("x"))
    both = c.union(table(spark, sf_dir, "supplier").select("s_name"))
    return both.select(F.trim(F.get(F.split("x", " / "), F.lit(0))).alias("name")).where(~F.col("name").isin("MACHINERY")).distinct()


@query(r"""
  SELECT p_partkey, regexp_replace(p_name, '\s', '', 'g') AS no_tags, upper(left(p_type, 3)) = 'ECO' AS eco FROM part
""".replace(r"regexp_replace(p_name, '\s', '', 'g') AS no_tags, upper(left(p_type, 3)) = 'ECO' AS eco", "replace(p_name, ' ', '') AS joined, p_name || ' ' AS spaced, '&lt;' || p_name || '&gt;' AS escaped, lower(replace(replace(p_brand, '#', ''), ' ', '')) AS token"))
def text_helpers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tagged = F.concat(F.lit("<b>"), F.replace("p_name", F.lit(" "), F.lit("<i></i>")), F.lit("</b>"))
    return p.select(
        "p_partkey", X.strip_tags(tagged, with_blank=False).alias("joined"), F.concat(X.squeeze(F.concat(F.lit("  "), "p_name")), F.lit(" ")).alias("spaced"),
        X.escape_html(F.concat(F.lit("<"), "p_name", F.lit(">"))).alias("escaped"), X.token("p_brand").alias("token"),
    )
