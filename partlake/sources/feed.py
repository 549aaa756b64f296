"""Part-number feeds derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LISTS = {
    "cover": ["32", "33", "51", "52"], "cover_class": ["W", "F", "Z", "K"], "num": ["9", "11", "13", "15", "17", "19", "21", "23", "25"],
    "nr": ["N", "R"], "dummy": ["22", "50", "31", "36"], "size": list("ABCDEFGHJ"), "abc": ["A", "B", "C"],
    "noise": ["MS27467T", "M38999/", "XYZ-", "D38999/"], "sheet": ["20", "24", "26", "21", "23", "40", "46", "43", "99"],
    "cls": ["W", "F", "K", "Z", "AA", "J", "Y", "N", "M"], "contact": list("PSABHJX"), "key": ["N", "A", "B", "C", "D", "E", ""],
}


def feed_sql(dialect: str) -> str:
    """The feed as SQL; ``dialect`` is ``spark`` or ``duckdb``."""

    def pick(name: str, at: str) -> str:
        items = ", ".join(f"'{x}'" for x in _LISTS[name])
        return f"element_at(array({items}), CAST({at} AS INT))" if dialect == "spark" else f"[{items}][CAST({at} AS INT)]"

    return f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST((l_orderkey + l_linenumber) % 8 AS INT) AS variant,
      CASE (l_orderkey + l_linenumber) % 8
        WHEN 5 THEN concat('D38999/', {pick("cover", "l_partkey % 4 + 1")}, {pick("cover_class", "l_suppkey % 4 + 1")},
                           {pick("num", "l_partkey % 9 + 1")}, {pick("nr", "l_linenumber % 2 + 1")})
        WHEN 6 THEN concat('D38999/', {pick("dummy", "l_partkey % 4 + 1")},
                           CASE WHEN l_partkey % 4 < 2
                                THEN concat({pick("size", "l_suppkey % 9 + 1")}, CASE WHEN l_linenumber % 2 = 0 THEN '1' ELSE '' END, 'W')
                                ELSE concat('W', {pick("abc", "l_suppkey % 3 + 1")}, CAST(1 + l_partkey % 61 AS STRING), 'PN',
                                            CAST(l_linenumber % 10 AS STRING)) END)
        WHEN 7 THEN concat({pick("noise", "l_partkey % 4 + 1")}, CAST(l_partkey AS STRING))
        ELSE concat(CASE WHEN l_linenumber % 2 = 0 THEN 'd38999/' ELSE 'D38999/' END, {pick("sheet", "l_orderkey % 9 + 1")}, ' ',
                    {pick("cls", "l_partkey % 9 + 1")}, {pick("size", "l_suppkey % 9 + 1")}, '-', CAST(1 + (l_partkey % 61) AS STRING),
                    {pick("contact", "l_partkey % 7 + 1")}, {pick("key", "(l_orderkey + l_partkey) % 7 + 1")})
      END AS raw_pn
    FROM {{lineitem}}
    """


def part_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: keys, ``variant`` and ``raw_pn`` in mixed case with a blank and a hyphen."""
    return spark.sql(feed_sql("spark"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


FEED = feed_sql("duckdb").format(lineitem="lineitem")
