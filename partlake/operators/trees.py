"""JSON documents of any depth, level by level.

A document is a VARIANT. A level's objects and arrays are opened by one lateral
``variant_explode``, which makes the next level; the levels are written to the scratch folder
until one is empty, so there are as many passes as the deepest document has levels, over
no more than what is left to open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.scratch import Scratch


def canonical(text: str) -> Column:
    """The document with the keys of every object in order and no blanks: equal documents give equal texts.

    Numbers lose trailing zeros and exponents are written out. Null for null texts, for texts that
    are no JSON, and for objects that repeat a key.
    """
    return F.to_json(F.try_parse_json(F.col(text)))


def same_document(a: str, b: str) -> Column:
    """Whether two texts are the same document; null where one is none."""
    return canonical(a) == canonical(b)


def _text(v: Column, path: str = "$") -> Column:
    """What lies at the path, if it is a text and not empty, else null."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.nullif(F.try_variant_get(at, "$", "string"), F.lit("")))


def walk(docs: DataFrame, id_col: str, doc: str, inherit: tuple[str, ...] = ()) -> DataFrame:
    """(id, depth, key, listed, ``inherited``, value): every value of every document.

    ``key`` is the member's name; an element of an array has the array's name and is
    ``listed``. ``inherited`` is what the objects above say: the first of the ``inherit``
    members that is a text in the nearest object that has one, not the value's own. ``value`` is
    a VARIANT. Documents that are null or no JSON have no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "walk")
    none = F.lit(None).cast("string")
    level = docs.select(
        F.col(id_col).alias("id"), F.lit(0).alias("depth"), none.alias("key"), F.lit(False).alias("listed"), none.alias("inherited"), F.try_parse_json(doc).alias("value")
    )
    levels = []
    while True:
        # texts that are no JSON go when they are read back: a filter ahead would parse every document twice
        level = scratch.write(level, "level", keep=True).where("value IS NOT NULL")
        if level.limit(1).count() == 0:
            break
        levels.append(level)
        own = F.coalesce(*[_text(F.col("value"), f"$.{k}") for k in inherit], "inherited") if inherit else none
        kind = F.schema_of_variant("value")
        open_ = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")).select("id", "depth", F.col("key").alias("above"), own.alias("inherited"), F.col("value").alias("v"))
        below = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = below.select(
            "id", (F.col("depth") + 1).alias("depth"), F.coalesce("key", "above").alias("key"), F.col("key").isNull().alias("listed"), "inherited", "value"
        )
    if not levels:
        return level.withColumnRenamed("id", id_col)
    return reduce(DataFrame.unionAll, levels).withColumnRenamed("id", id_col)


def listed_parts(walked: DataFrame, id_col: str, member: str) -> DataFrame:
    """(id, family, pn, description): the elements of lists named ``member``, texts or objects with pn and description.

    The family is what stands above the list. Elements without a number are left out.
    """
    v = F.col("value")
    is_object = F.schema_of_variant("value").startswith("OBJECT")
    pn = F.when(is_object, _text(v, "$.pn")).otherwise(_text(v))
    description = F.when(is_object, F.coalesce(_text(v, "$.description"), F.lit(""))).otherwise("")
    rows = walked.where((F.col("key") == member) & F.col("listed"))
    return rows.select(id_col, F.coalesce("inherited", F.lit("")).alias("family"), pn.alias("pn"), description.alias("description")).where("pn IS NOT NULL")


def texts_under(walked: DataFrame, id_col: str, keys: list[str], start: str) -> DataFrame:
    """(id, text), different ones: members of these names that are texts and begin with ``start``."""
    rows = walked.where(F.col("key").isin(keys) & ~F.col("listed"))
    return rows.select(id_col, _text(F.col("value")).alias("text")).where(F.col("text").startswith(start)).distinct()
