"""Walking a part-number selector field by field, and the order of its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_key(c: Column) -> Column:
    """Sort key of a selector's values: whole numbers by value, then other texts by text."""
    number = F.when(c.rlike(r"^\d+$"), c.try_cast("decimal(38, 0)"))
    return F.struct(number.isNull().alias("is_text"), number.alias("number"), c.alias("text"))


def node_counts(catalog: DataFrame, path: list[str], leaf: str) -> DataFrame:
    """(node, n): different leaves under every prefix of the path; the root is the empty prefix.

    Leaves are made distinct by node and leaf before they are counted, so the root is no hot key.
    """
    fields = F.array(*[F.col(c).cast("string") for c in path])
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(len(path))), lambda i: F.slice(fields, F.lit(1), i))
    return catalog.select(F.explode(prefixes).alias("node"), F.col(leaf).alias("leaf")).distinct().groupBy("node").agg(F.count("leaf").alias("n"))


def walk_selection(asked: DataFrame, key: str, catalog: DataFrame, path: list[str], leaf: str) -> DataFrame:
    """(key, chosen, reached, broken, exact, matches) of each selection; ``key`` is unique.

    ``path`` are columns of both tables. The walk goes down while the field is chosen (not
    null) and the tree has its value. It is broken where a chosen field is not reached: then
    nothing matches. It is exact where all fields are chosen and reached.
    """
    names = [F.col(c).cast("string") for c in path]
    chosen = sum((c.isNotNull().cast("int") for c in names), F.lit(0))
    run, going = F.lit(0), F.lit(True)
    for c in names:
        going = going & c.isNotNull()
        run = run + going.cast("int")
    prefixes = F.transform(F.sequence(F.lit(0), run), lambda i: F.slice(F.array(*names), F.lit(1), i))
    steps = asked.select(F.col(key), chosen.alias("chosen"), F.posexplode(prefixes).alias("depth", "node"))
    met = steps.join(node_counts(catalog, path, leaf), "node")
    out = asked.select(F.col(key), chosen.alias("chosen")).join(met.groupBy(key).agg(F.max("depth").alias("reached"), F.max_by("n", "depth").alias("n")), key, "left")
    reached = F.coalesce("reached", F.lit(0))
    broken = reached < F.col("chosen")
    return out.select(
        key,
        "chosen",
        reached.alias("reached"),
        broken.alias("broken"),
        (~broken & (F.col("chosen") == len(path))).alias("exact"),
        F.when(broken, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("matches"),
    )
