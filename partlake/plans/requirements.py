"""Queries on electrical requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators import requirements
from partlake.plans.labels import pick, pick_sql
from partlake.plans.queries import _derate_sql, _power_sql, query, table

_FUNCS = ["uart", "coax", "can_bus", "ethernet_1g", "lamp", "rs485", "discrete"]


def requests(spark, sf_dir) -> DataFrame:
    """Three requirements a supplier: a power rail, a function, and another rail or its explicit return."""
    k = F.col("s_suppkey")
    rows = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("power").alias("function"), (k % 2 + 1).alias("count"), ((k % 9 + 1) * 2.0).alias("amps")),
        F.struct(F.lit(1).alias("pos"), pick(_FUNCS, k % 7).alias("function"), (k % 3 + 1).alias("count"), F.lit(0.0).alias("amps")),
        F.struct(F.lit(2).alias("pos"), F.when(k % 4 == 0, "power_return").otherwise("power").alias("function"), F.lit(1).cast("long").alias("count"), (k % 5 * 1.0).alias("amps")),
    )
    return table(spark, sf_dir, "supplier").select(k.alias("request"), F.explode(rows).alias("r")).select("request", "r.*")


def _case(values: dict, otherwise: str) -> str:
    return "CASE f1 " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {otherwise} END"


_POWER = _power_sql().replace("need AS (SELECT DISTINCT l_quantity AS amps, l_linenumber AS other FROM lineitem)", "need AS (SELECT a::DOUBLE AS amps, o AS other FROM range(1, 19) t(a), range(0, 260) u(o))")
_ROWS = f"""
  pw AS MATERIALIZED ({_POWER}),
  q AS (SELECT s_suppkey AS request, s_suppkey % 2 + 1 AS c0, (s_suppkey % 9 + 1) * 2.0::DOUBLE AS a0, {pick_sql(_FUNCS, "s_suppkey % 7")} AS f1, s_suppkey % 3 + 1 AS c1,
        s_suppkey % 4 = 0 AS back, (s_suppkey % 5)::DOUBLE AS a2 FROM supplier),
  q0 AS (SELECT q.*, size AS z0, n_contacts AS p0, {_case({f: n for f, (_, n, _) in requirements.FUNCTIONS.items()}, "1")} AS p1,
        {_case({f: s for f, (s, _, _) in requirements.FUNCTIONS.items()}, "'22D'")} AS z1 FROM q JOIN pw ON amps = a0 AND other = 0),
  q2 AS (SELECT q0.*, CASE WHEN a2 = 0 THEN '22D' ELSE size END AS z2, CASE WHEN a2 = 0 THEN 1 ELSE n_contacts END AS p2 FROM q0 LEFT JOIN pw ON amps = a2 AND other = c0 * p0 + c1 * p1),
  e AS (SELECT request, 0 AS pos, 'power' AS function, z0 AS size, p0 AS per, c0 AS instances, a0 AS amps FROM q2
        UNION ALL SELECT request, 1, f1, z1, p1, c1, 0.0 FROM q2
        UNION ALL SELECT request, 2, CASE WHEN back THEN 'power_return' ELSE 'power' END, z2, p2, 1, a2 FROM q2
        UNION ALL SELECT request, 0, 'power_return', z0, p0, c0, a0 FROM q2 WHERE NOT back UNION ALL SELECT request, 2, 'power_return', z2, p2, 1, a2 FROM q2 WHERE NOT back)
"""


@query(f"WITH {_ROWS} SELECT request, pos, function, size, per::INT AS per, instances::INT AS instances, amps::DOUBLE AS amps FROM e")
def requirement_rows(spark, sf_dir):
    return requirements.expand(requests(spark, sf_dir)).select("request", F.explode("rows").alias("r")).select("request", "r.*")


@query(f"""
  WITH {_ROWS}, n AS (SELECT request, size, sum(per * instances)::BIGINT AS contacts, max(amps) FILTER (WHERE function LIKE 'power%') AS rail_amps,
    coalesce(sum(instances) FILTER (WHERE function LIKE 'power%'), 0)::BIGINT AS rails FROM e GROUP BY ALL),
  t AS (SELECT request, sum(contacts)::BIGINT AS total FROM n GROUP BY request)
  SELECT n.*, total, greatest(2, total * 15 // 100)::BIGINT AS target FROM n JOIN t USING (request)
""")
def requirement_sizes(spark, sf_dir):
    needed = requirements.needs(requirements.expand(requests(spark, sf_dir)))
    return needed.join(requirements.spares(needed, 15), "request")


_SIGNALS = "CASE function " + " ".join("WHEN '" + f + "' THEN [" + ", ".join(f"'{x}'" for x in s) + "][j]" for f, (_, _, s) in requirements.FUNCTIONS.items() if s) + " END"


@query(f"""
  WITH {_ROWS}, i AS (SELECT *, unnest(range(1, instances + 1)) AS i FROM e), j AS (SELECT *, unnest(range(1, per + 1)) AS j FROM i)
  SELECT request, CASE WHEN function LIKE 'power%' THEN CASE function WHEN 'power' THEN 'V+' ELSE 'V-/RTN' END || CASE WHEN instances > 1 THEN ' rail #' || i ELSE '' END || CASE WHEN per > 1 THEN ' p' || j ELSE '' END
      WHEN function = 'lamp' THEN 'lamp #' || i WHEN function IN ('coax', 'discrete') THEN upper(function) || CASE WHEN instances > 1 THEN ' #' || i ELSE '' END
      ELSE {_SIGNALS} || CASE WHEN instances > 1 THEN ' #' || i ELSE '' END END AS signal, function, size,
    CASE function WHEN 'power' THEN 'RED' WHEN 'power_return' THEN 'BLACK' ELSE '' END AS color FROM j
""")
def requirement_pins(spark, sf_dir):
    return requirements.pins(requirements.expand(requests(spark, sf_dir)))


@query(f"""
  WITH {_ROWS}, b AS (SELECT request, c0 * a0 + CASE WHEN back THEN 0 ELSE a2 END AS budget, f1, a0 FROM q2)
  SELECT request, concat_ws('; ', CASE WHEN f1 = 'ethernet_1g' THEN 'validate the cable assembly for gigabit signals' END,
    CASE WHEN f1 IN ('rs485', 'can_bus') THEN 'keep bus pairs adjacent and terminate the ends' END, CASE WHEN a0 > 13 THEN 'check the temperature at full load' END,
    'power budget ' || printf('%.1f', budget) || ' A') AS notes FROM b
""")
def requirement_notes(spark, sf_dir):
    return requirements.design_notes(requests(spark, sf_dir)).select("request", F.array_join("notes", "; ").alias("notes"))


@query(f"""
  WITH need AS (SELECT DISTINCT l_quantity AS amps, l_linenumber AS other FROM lineitem)
  SELECT amps, other, (SELECT min(n)::INT FROM range(1, 21) r(n) WHERE n * (13.0 * {_derate_sql("(need.other + n)")}) * 100 >= need.amps * 125
      AND (need.amps <= 13 OR (n >= 2 AND (n - 1) * (13.0 * {_derate_sql("(need.other + n)")}) >= need.amps))) AS n FROM need
""")
def forced_size(spark, sf_dir):
    need = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("amps"), F.col("l_linenumber").alias("other")).distinct()
    return need.withColumn("n", requirements.forced_contacts(F.col("amps"), "16", F.col("other")))


_TYPES = ["plug", "jam_nut_receptacle", "wall_mount_receptacle", "odd"]


@query(f"""
  WITH c AS (SELECT p_partkey, {pick_sql(_TYPES, "p_partkey % 4")} AS kind, CASE WHEN p_size % 2 = 0 THEN 'III' ELSE 'IV' END AS series, {pick_sql([n for _, n in R.SHELL_SIZES] + ["7"], "p_size % 10")} AS z FROM part)
  SELECT p_partkey, 'D38999/' || CASE kind || '|' || series {" ".join(f"WHEN '{k}|{s}' THEN '{v}'" for (k, s), v in requirements.SHEETS.items())} ELSE '26' END || 'W'
    || CASE z {" ".join(f"WHEN '{n}' THEN '{c}'" for c, n in R.SHELL_SIZES)} ELSE '?' END || p_partkey % 61 || 'PN' AS pn FROM c
""")
def suggested_numbers(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    series = F.when(s % 2 == 0, "III").otherwise("IV")
    pn = requirements.candidate_number(pick(_TYPES, k % 4), series, F.lit("W"), pick([n for _, n in R.SHELL_SIZES] + ["7"], s % 10), (k % 61).cast("string"), "P")
    return table(spark, sf_dir, "part").select("p_partkey", pn.alias("pn"))


