"""Queries on the selector, on lists and on counts of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partlake.operators import listing, selector
from partlake.plans.queries import query, table


@query("""
  WITH a AS (SELECT p_partkey AS k, p_brand AS b, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS t, CASE p_partkey % 3 WHEN 1 THEN p_size WHEN 2 THEN p_size + 100 END AS s FROM part),
  n1 AS (SELECT p_brand, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL), n2 AS (SELECT p_brand, p_type, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL),
  n3 AS (SELECT p_brand, p_type, p_size, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL),
  w AS (SELECT k, (1 + (t IS NOT NULL)::INT + (s IS NOT NULL)::INT)::INT AS chosen, CASE WHEN t IS NULL THEN 1 WHEN n3.n IS NULL THEN 2 ELSE 3 END AS reached,
      n1.n AS c1, n2.n AS c2, n3.n AS c3
    FROM a JOIN n1 ON n1.p_brand = b LEFT JOIN n2 ON n2.p_brand = b AND n2.p_type = t LEFT JOIN n3 ON n3.p_brand = b AND n3.p_type = t AND n3.p_size = s)
  SELECT k, chosen, reached, reached < chosen AS broken, reached = 3 AND chosen = 3 AS exact,
    CASE WHEN reached < chosen THEN 0 WHEN reached = 3 THEN c3 WHEN reached = 2 THEN c2 ELSE c1 END AS matches FROM w
""")
def selector_walk(spark, sf_dir):
    """Every part asks by brand, type and size: some without a type, some without a size, some with a size that is not there."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    asked = part.select(
        k.alias("k"), "p_brand", F.when(k % 5 > 0, F.col("p_type")).alias("p_type"),
        F.when(k % 3 == 1, F.col("p_size")).when(k % 3 == 2, F.col("p_size") + 100).alias("p_size"),
    )
    return selector.walk_selection(asked, "k", part, ["p_brand", "p_type", "p_size"], "p_partkey")


@query(r"""
  WITH v AS (SELECT DISTINCT p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_type END AS v FROM part)
  SELECT p_brand, v, row_number() OVER (PARTITION BY p_brand ORDER BY NOT regexp_full_match(v, '\d+'), TRY_CAST(v AS BIGINT), v)::INT AS place FROM v
""")
def selector_order(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type"))
    v = table(spark, sf_dir, "part").select("p_brand", value.alias("v")).distinct()
    return v.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(selector.value_key(F.col("v")))))


_REGIONS = ["ASIA", "EUROPE", "AMERICA"]


@query("""
  SELECT r_name AS category, CASE r_name WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2 WHEN 'AMERICA' THEN 3 ELSE 4 END AS place, count(*) AS n, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def entries_by_category(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    out = listing.by_category(rows.withColumnRenamed("r_name", "category"), "category", _REGIONS, ["n_name"])
    return out.select("category", "place", "n", F.array_join("n_name", ",").alias("names"))


@query("""
  WITH w AS (SELECT greatest(4, max(length(p_partkey::VARCHAR))) AS a, greatest(5, max(length(p_brand))) AS b, max(length(p_type)) AS c FROM part)
  SELECT p_partkey, rtrim(rpad(p_partkey::VARCHAR, a::INT, ' ') || '  ' || rpad(p_brand, b::INT, ' ') || '  ' || rpad(p_type, greatest(c, 4)::INT, ' ')) AS line FROM part, w
""")
def padded_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return listing.padded_rows(part, {"p_partkey": "Part", "p_brand": "Brand", "p_type": "Type"}).select("p_partkey", "line")


@query("SELECT o_orderkey, o_custkey % 9 + 1 AS page, o_custkey + 10 AS pages, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 1000 + 7 END AS total FROM orders")
def page_counters(spark, sf_dir):
    """The total is missing from every third page, the page's own number from none."""
    o = table(spark, sf_dir, "orders")
    total = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("<b>"), F.format_number(F.col("o_orderkey") * 1000 + 7, 0), F.lit(" records</b>"))).otherwise("")
    html = F.concat(F.lit("<span>Page "), F.col("o_custkey") % 9 + 1, F.lit(" of "), F.col("o_custkey") + 10, F.lit("</span>"), total)
    at, pattern = o.select("o_orderkey", html.alias("html")), r"Page\s+(\d+)\s+of\s+(\d+)"
    return at.select(
        "o_orderkey", listing.counter(F.col("html"), pattern, 1, True).alias("page"), listing.counter(F.col("html"), pattern, 2, True).alias("pages"),
        listing.counter(F.col("html"), r"([\d,]+) records").alias("total"),
    )


@query("""
  WITH a AS (SELECT l_partkey % 60 AS size, max(l_quantity) AS max_amps, sum(l_linenumber)::BIGINT AS needed FROM lineitem GROUP BY ALL), b AS (SELECT p_size AS size, (sum(p_partkey % 40))::BIGINT AS available FROM part GROUP BY ALL)
  SELECT a.size, max_amps, needed, coalesce(available, 0) AS available, greatest(0, needed - coalesce(available, 0)) AS short FROM a LEFT JOIN b ON a.size = b.size
""")
def demand_by_size(spark, sf_dir):
    rails = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("size"), "l_quantity", "l_linenumber")
    stock = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") % 40).alias("have"))
    return listing.demand_by_size(rails, stock, "size", "l_quantity", "l_linenumber", "have")


_FILES = "SELECT DISTINCT 'list_' || c_custkey % 700 || CASE WHEN c_custkey % 3 = 0 THEN '_part_details.json' ELSE '_part_numbers.json' END AS name FROM customer"


@query(f"WITH f AS ({_FILES}) SELECT name FROM f WHERE name LIKE '%\\_part\\_numbers.json' ESCAPE '\\' AND replace(name, '_part_numbers', '_part_details') NOT IN (SELECT name FROM f)")
def files_to_read(spark, sf_dir):
    """Bare lists give way to the detailed ones of the same name."""
    k = F.col("c_custkey")
    end = F.when(k % 3 == 0, "_part_details.json").otherwise("_part_numbers.json")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("list_"), k % 700, end).alias("name"))
    return listing.without_superseded(files, "name", "_part_numbers.json", "_part_details.json")


@query("SELECT split_part(c_name, '#', 2) AS number FROM customer INTERSECT SELECT split_part(s_name, '#', 2) FROM supplier")
def shared_numbers(spark, sf_dir):
    number = lambda name, c: table(spark, sf_dir, name).select(F.substring_index(c, "#", -1).alias("number"))
    return number("customer", "c_name").intersect(number("supplier", "s_name"))


@query("""
  SELECT 'part' AS section, count(*) AS n, count(DISTINCT p_brand) AS n_groups FROM part UNION ALL SELECT 'supplier', count(*), count(DISTINCT s_nationkey) FROM supplier
  UNION ALL SELECT 'order', count(*), count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'document', count(*), count(DISTINCT source) FROM documents
""")
def source_counts(spark, sf_dir):
    """Rows and different groups of each section, in one row a section."""

    def section(title: str, name: str, group: str) -> DataFrame:
        return table(spark, sf_dir, name).agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups")).select(F.lit(title).alias("section"), "n", "n_groups")

    parts = [("part", "part", "p_brand"), ("supplier", "supplier", "s_nationkey"), ("order", "orders", "o_orderstatus"), ("document", "documents", "source")]
    return reduce(DataFrame.union, [section(*x) for x in parts])
