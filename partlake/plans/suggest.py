"""Suggestions: arrangements for requirements, and what joins on ranges answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators import electrical, ranges, requirements, suggestion
from partlake.plans.labels import pick, pick_sql
from partlake.plans.queries import _LIST, _derate_sql, query, table
from partlake.plans.requirements import _ROWS, requests

_CONTACTS = ["22D", "20", "16", "12", "12 Coax", "8 Twinax"]
_NUMBERS = [n for _, n in R.SHELL_SIZES]
_ALL = suggestion.SIZE_ORDER + ["12 Coax", "8 Twinax"]
_POWER = list(reversed(electrical.POWER_SIZES))
_RATED = [(s, a) for s, a, *_ in R.RATINGS if s in _POWER]


def contacts(spark, sf_dir) -> DataFrame:
    """(p_size, size, count): one arrangement a part size, with contacts of six sizes."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_size", pick(_CONTACTS, F.col("p_partkey") % 6).alias("size")).agg((F.sum("p_partkey") % 23).alias("count"))


@query(f"""
  WITH RECURSIVE {_ROWS},
  o AS (SELECT *, function = 'power_return' AND request % 4 <> 0 AS added FROM e),
  n AS (
    SELECT *, row_number() OVER (PARTITION BY request ORDER BY seen) AS step FROM (
      SELECT request, size, sum(per * instances)::BIGINT AS c, max(amps) FILTER (function = 'power') AS amps,
        coalesce(sum(instances) FILTER (function = 'power' OR added), 0)::BIGINT AS rails, min(CASE WHEN added THEN 10 + pos ELSE pos END) AS seen
      FROM o GROUP BY ALL)),
  last AS (SELECT request, max(step) AS steps, sum(c)::BIGINT AS total FROM n GROUP BY request),
  fit AS (SELECT amps, other, size, min(m) AS m FROM (SELECT DISTINCT amps FROM n WHERE amps IS NOT NULL) CROSS JOIN range(0, 300) u(other)
    CROSS JOIN (VALUES {R.values(_RATED)}) s(size, rated) CROSS JOIN range(1, 21) r(m)
    WHERE m * (rated * {_derate_sql("(other + m)")}) * 100 >= amps * 125 AND (amps <= 13 OR (m >= 2 AND (m - 1) * (rated * {_derate_sql("(other + m)")}) >= amps)) GROUP BY ALL),
  f AS (SELECT amps, other, [{", ".join(f"max(CASE size WHEN '{s}' THEN m END)" for s in _POWER)}] AS m FROM fit GROUP BY ALL),
  k AS (SELECT p_size, {pick_sql(_CONTACTS, "p_partkey % 6")} AS size, (sum(p_partkey) % 23)::BIGINT AS count FROM part GROUP BY ALL),
  a AS (SELECT p_size, [{", ".join(f"coalesce(max(CASE size WHEN '{s}' THEN count END), 0)" for s in _ALL)}]::BIGINT[] AS rest FROM k GROUP BY p_size),
  r AS (
    SELECT request, p_size, 0::BIGINT AS step, rest, 0::BIGINT AS used, ''::VARCHAR AS uses, 0 AS splits, 0 AS upsizes, list_sum(rest) AS cavities FROM last CROSS JOIN a
    UNION ALL
    SELECT request, p_size, step + 1, list_transform(rest, lambda x, q: CASE WHEN q = j THEN x - take ELSE x END), used + take,
      uses || CASE WHEN step = 0 THEN '' ELSE ',' END || size || '>' || [{_LIST(_ALL)}][j] || ':' || take, splits + (kind = 2)::INT, upsizes + (kind = 1)::INT, cavities
    FROM (
      SELECT *, CASE kind WHEN 0 THEN i WHEN 1 THEN up ELSE [{", ".join(str(_ALL.index(s) + 1) for s in _POWER)}][sp] END AS j, CASE WHEN kind < 2 THEN c ELSE m[sp] * rails END AS take
      FROM (SELECT *, CASE WHEN rest[i] >= c THEN 0 WHEN up IS NOT NULL THEN 1 WHEN sp IS NOT NULL THEN 2 END AS kind FROM (
        SELECT r.request, r.p_size, r.step, r.rest, r.used, r.uses, r.splits, r.upsizes, r.cavities, n.size, n.c, n.rails, n.i, f.m,
          list_filter(range(n.i + 1, CASE WHEN n.i <= 8 THEN 9 ELSE n.i END), lambda x: r.rest[x] >= n.c)[1] AS up,
          CASE WHEN n.rails > 0 THEN list_filter([1, 2, 3, 4], lambda x: [{", ".join(str(_ALL.index(s) + 1) for s in _POWER)}][x] <> n.i
            AND f.m[x] * n.rails <= r.rest[[{", ".join(str(_ALL.index(s) + 1) for s in _POWER)}][x]])[1] END AS sp
        FROM r JOIN (SELECT *, list_position([{_LIST(_ALL)}], size) AS i FROM n) n ON n.request = r.request AND n.step = r.step + 1
          LEFT JOIN f ON f.amps = n.amps AND f.other = r.used)) WHERE kind IS NOT NULL)),
  d AS (SELECT r.*, total, list_sum(rest) AS spare, list_sum(rest) >= greatest(2, total * 15 // 100) AS meets FROM r JOIN last USING (request) WHERE step = steps),
  p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY (splits > 0)::INT, upsizes, (NOT meets)::INT, spare DESC, cavities, p_size) AS place FROM d),
  z AS (SELECT *, {pick_sql(_NUMBERS, "p_size % 9")} AS shell FROM p WHERE place <= 5)
  SELECT l.request, l.total, place, p_size, uses, splits, upsizes, spare::BIGINT AS spare, meets AS meets_spare,
    'D38999/26W' || CASE shell {" ".join(f"WHEN '{n}' THEN '{c}'" for c, n in R.SHELL_SIZES)} ELSE '?' END || p_size || 'PN' AS pin,
    'D38999/26W' || CASE shell {" ".join(f"WHEN '{n}' THEN '{c}'" for c, n in R.SHELL_SIZES)} ELSE '?' END || p_size || 'SN' AS socket
  FROM last l LEFT JOIN z ON z.request = l.request
""")
def connector_suggestions(spark, sf_dir):
    """Requirements to ranked arrangements and their part numbers, every request against every arrangement that can suffice."""
    best = suggestion.suggest(requests(spark, sf_dir), contacts(spark, sf_dir), "p_size")
    shell = pick(_NUMBERS, F.col("p_size") % 9)
    number = lambda c: requirements.candidate_number(F.lit("plug"), F.lit("III"), F.lit("W"), shell, F.col("p_size").cast("string"), c)
    uses = F.array_join(F.transform("uses", lambda u: F.concat(u["size"], F.lit(">"), u["at"], F.lit(":"), u["contacts"].cast("string"))), ",")
    return best.withColumns({"uses": uses, "pin": number("P"), "socket": number("S")})
