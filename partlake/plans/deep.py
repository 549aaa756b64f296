"""Queries on nested documents, numbered combinations and signatures in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators import combinations, convert, dispatch, grounding, trees
from partlake.operators.spread import spread
from partlake.plans.queries import ORACLE, convert_forward, query, table

# a leaf object, then as many objects or arrays around it as the part's number says
_LEAF = """concat('{"pn":"D38999/26WB', p_partkey % 99, 'PN","verified":["V', p_partkey, '",{"pn":"W', p_partkey % 7, '","description":"', p_name, '"},{"pn":""},""', CASE WHEN p_size % 3 = 0 THEN ',{"pn":"","x":[1]}' ELSE '' END,
  '],"more":[{"series":"S', p_size % 4, '","part_number":"D38999/20FC', p_partkey % 50, 'SN","verified":["U', p_size, '"]},{"b":1.50,"a":null}]', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(',"family":"F', p_partkey % 6, '"') END, '}')"""


_WRAP = """CASE WHEN p_size % 7 < {i} THEN {d} WHEN (p_partkey + {i}) % 3 = 0 THEN concat('{{"level', {i}, '":', {d}, ',"family":"G', p_size % 5, '"}}')
  WHEN (p_partkey + {i}) % 3 = 1 THEN concat('[', {d}, ',[]]') ELSE concat('{{"verified":[', {d}, '],"partNumber":"D38999/', p_size, '"}}') END"""


def nested_documents(spark, sf_dir) -> DataFrame:
    """(id, doc): a document a part, up to ten levels deep."""
    doc = F.expr(f"aggregate(sequence(1, 6), {_LEAF}, (d, i) -> {_WRAP.format(d='d', i='i')})")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"))
    return rows.select(F.col("p_partkey").alias("id"), doc.alias("doc"))


_STEPS = f"x0 AS (SELECT *, {_LEAF} AS d0 FROM part), " + ", ".join(f"x{i} AS (SELECT *, {_WRAP.format(d=f'd{i - 1}', i=i)} AS d{i} FROM x{i - 1})" for i in range(1, 7))
_TREE = f"""{_STEPS},
  t AS (SELECT p_partkey AS id, j.id AS node, j.parent, j.key, j.value, j.type, j.atom FROM x6, json_tree(x6.d6) j),
  w AS (
    SELECT id, node, NULL::VARCHAR AS key, false AS listed, NULL::VARCHAR AS inherited, type, value FROM t WHERE parent IS NULL
    UNION ALL
    SELECT t.id, t.node, CASE w.type WHEN 'ARRAY' THEN w.key ELSE t.key END, w.type = 'ARRAY',
      CASE w.type WHEN 'OBJECT' THEN coalesce(nullif(w.value ->> '$.family', ''), nullif(w.value ->> '$.series', ''), w.inherited) ELSE w.inherited END, t.type, t.value
    FROM w JOIN t ON t.id = w.id AND t.parent = w.node)"""


@query(f"""
  WITH RECURSIVE {_TREE}
  SELECT id, coalesce(inherited, '') AS family, CASE type WHEN 'OBJECT' THEN value ->> '$.pn' ELSE value ->> '$' END AS pn, CASE type WHEN 'OBJECT' THEN coalesce(value ->> '$.description', '') ELSE '' END AS description
  FROM w WHERE key = 'verified' AND listed AND CASE type WHEN 'OBJECT' THEN value ->> '$.pn' WHEN 'VARCHAR' THEN value ->> '$' END <> ''
""")
def deep_listed_parts(spark, sf_dir):
    """Elements of lists at any depth, with the family that the objects above them name."""
    return trees.listed_parts(trees.walk(nested_documents(spark, sf_dir), "id", "doc", ("family", "series")), "id", "verified")


@query(f"""
  WITH RECURSIVE {_TREE}
  SELECT DISTINCT id, value ->> '$' AS text FROM w WHERE key IN ('partNumber', 'part_number', 'pn') AND NOT listed AND type = 'VARCHAR' AND starts_with(value ->> '$', 'D38999/')
""")
def deep_numbers(spark, sf_dir):
    return trees.texts_under(trees.walk(nested_documents(spark, sf_dir), "id", "doc"), "id", ["partNumber", "part_number", "pn"], "D38999/")


@query("""
  SELECT event_id, '{"a":{"b":[' || event_id % 3 || ',{"x":null,"y":"' || event_type || '"}],"c":' || (event_id % 2 = 0) || '},"k":' || event_id % 7 || '}' AS canonical, event_id % 5 > 0 AS same FROM events
""")
def canonical_documents(spark, sf_dir):
    """One document written in two ways; one in five differs."""
    i = F.col("event_id")
    b = (i % 2 == 0).cast("string")
    one = F.concat(F.lit('{"k": '), i % 7, F.lit(', "a" : {"c":'), b, F.lit(',"b":[ '), i % 3, F.lit(',{"y":"'), "event_type", F.lit('","x":null}]}}'))
    other = F.concat(F.lit('{"a":{"b":['), i % 3, F.lit(',{"x":null,"y":"'), "event_type", F.lit('"}], "c":'), b, F.lit('},\n"k":'), F.when(i % 5 == 0, i % 7 + 1).otherwise(i % 7), F.lit("}"))
    e = table(spark, sf_dir, "events").select("event_id", one.alias("one"), other.alias("other"))
    return e.select("event_id", trees.canonical("one").alias("canonical"), trees.same_document("one", "other").alias("same"))


# --- combinations -------------------------------------------------------------------------
def cells(spark, sf_dir) -> DataFrame:
    """A cell a rule row and shell size: the inserts of that shell, two contacts and two keys at most."""
    shells = F.array(*[F.lit(c) for c, _ in R.SHELL_SIZES])
    p = table(spark, sf_dir, "part").select(F.get(shells, (F.col("p_size") % 9).cast("int")).alias("size"), (F.col("p_partkey") % 61).cast("string").alias("i"))
    inserts = p.groupBy("size").agg(F.array_sort(F.collect_set("i")).alias("insert"))
    one = lambda c, letters: F.filter(F.array(*[F.lit(x) for x in letters]), lambda x: F.call_function("contains", F.col(c), x)).alias(c)
    rules = convert.rules(spark).withColumn("size", F.explode(F.when(F.col("sizes") == "", shells).otherwise(F.filter(F.split("sizes", ""), lambda x: x != ""))))
    rules = rules.select("ord", F.col("rule_sheet").alias("sheet"), F.col("rule_class").alias("class"), "size", one("contacts", "PS").alias("contact"), one("keys", "NA").alias("key"))
    return rules.join(F.broadcast(inserts), "size")  # nine rows


_CELL_ROWS = [(r[0], r[9], r[10], s, "".join(x for x in "PS" if x in r[7]), "".join(x for x in "NA" if x in r[8])) for r in R.rule_rows() for s in (r[6] or "ABCDEFGHJ")]
_CELLS = f"""
  i AS (SELECT size, list(DISTINCT i ORDER BY i) AS ins FROM (SELECT 'ABCDEFGHJ'[p_size % 9 + 1] AS size, (p_partkey % 61)::VARCHAR AS i FROM part) GROUP BY size),
  r(ord, sheet, class, size, cs, ks) AS (VALUES {R.values(_CELL_ROWS)}),
  n AS (SELECT r.*, ins, len(ins) * length(cs) * length(ks) AS n FROM r JOIN i USING (size)),
  l AS (SELECT *, sum(n) OVER (ORDER BY ord, sheet, class, size ROWS UNBOUNDED PRECEDING) - n AS first FROM n WHERE n > 0),
  t AS (SELECT sum(n)::BIGINT AS total FROM n)"""


@query(f"""
  WITH {_CELLS}, a AS (SELECT l.*, unnest(range(n::BIGINT)) AS q FROM l)
  SELECT sheet, class, size, count(*) AS n, count(DISTINCT sheet || class || size || ins[q // (length(cs) * length(ks)) + 1] || cs[q // length(ks) % length(cs) + 1] || ks[q % length(ks) + 1]) AS n_numbers FROM a GROUP BY ALL
""")
def combination_counts(spark, sf_dir):
    """Every combination that the rules allow, made from its number, counted by sheet, class and shell."""
    made = combinations.all_combinations(cells(spark, sf_dir), ["insert", "contact", "key"])
    pn = F.concat("sheet", "class", "size", "insert", "contact", "key")
    return made.groupBy("sheet", "class", "size").agg(F.count("*").alias("n"), F.count_distinct(pn).alias("n_numbers"))


@query()
def combination_sample(spark, sf_dir):
    """3000 different combinations out of all, tested against plain Python."""
    out = combinations.sample(cells(spark, sf_dir), ["insert", "contact", "key"], ["ord", "sheet", "class", "size"], 3000, 0)
    return out.select("number", "ord", F.concat(F.lit("D38999/"), "sheet", "class", "size", "insert", "contact", "key").alias("pn"))


# --- grounding ----------------------------------------------------------------------------
_SIGNS = sorted({(r[1], r[0], (r[5] or r[11].removesuffix("-"))) for r in R.rule_rows()})


@query(f"""
  WITH s(vendor, ord, sign) AS (VALUES {R.values(_SIGNS)}), c AS ({ORACLE["convert_forward"]}),
  x AS (SELECT vendor, normalized, string_agg(lower(vendor_pn), ' ') AS text FROM c GROUP BY ALL),
  g AS (SELECT DISTINCT vendor, sign FROM s)
  SELECT g.vendor, sign AS signature, count(x.text) FILTER (contains(x.text, lower(sign)) AND sign <> '') AS n_texts FROM g LEFT JOIN x ON x.vendor = g.vendor GROUP BY ALL
""")
def rules_grounded(spark, sf_dir):
    """In how many of a vendor's catalog texts each of its rules' signatures stands, whatever the case; a text holds the vendor's numbers of one part."""
    signs = convert.rules(spark).select("vendor", dispatch.rule_signature().alias("signature"))
    texts = convert_forward(spark, sf_dir).groupBy("vendor", "normalized").agg(F.array_join(F.collect_list(F.lower("vendor_pn")), " ").alias("text"))
    return grounding.grounded(signs, texts, "vendor", "signature", "text", ignore_case=True)
