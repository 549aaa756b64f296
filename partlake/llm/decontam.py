"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's shingles are put in the order of a hash; its sketch is the first ones of that
order (its minimum hashes). Items are partitioned by the size of their shingle set, and
the sketch of a partition is as long as its largest item can miss shingles and still
count as contained, plus one: a document that contains an item holds at least one
shingle of its sketch. The search for short items in long documents is thus a lookup of
sketches, whose length follows from the small side alone, and finds every leak; candidates
are then verified by exact containment of the item's shingles, as strings.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.llm.rows import drop_keys, fresh
from partlake.llm.scratch import Scratch

BLANK = "[\\x20\\x09-\\x0D]+"
#: Rows up to which a lookup side is broadcast: about 24 bytes a sketch row, 80 a shingle row.
BROADCAST_ROWS = 400_000


def words(text: Column) -> Column:
    """Lower-case words, runs without space and U+0009 to U+000D; none for null."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK)
    return F.filter(split, lambda w: w != "")


def _shingles(w: str, k: int, form) -> Column:
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: form(F.slice(w, i, k)))
    some = F.when(n >= k, runs).when(n > 0, F.array(form(F.col(w))))
    return F.array_distinct(F.coalesce(some, F.array().cast("array<string>" if form is _joined else "array<bigint>")))


def _joined(w: Column) -> Column:
    return F.array_join(w, " ")


def _hashed(w: Column) -> Column:
    return F.xxhash64(w)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    k: int = 5,
    num: int = 4,
    den: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
    row_col: str | None = None,
) -> DataFrame:
    """(id, item, ``n_shared``, ``n_item``, ``containment``) of every pair with ``den * n_shared >= num * n_item``.

    A set holds the distinct ``k``-word shingles of a text, or its whole word sequence where
    it has fewer words, so such an item is found only in documents of just these words.
    Null and blank texts and items match nothing. Rows that repeat an id are judged one by
    one and reported once, with the most shared shingles; items that repeat an id likewise.
    With ``row_col``, rows that repeat an id are reported each, told apart by a hash of their
    text in that column. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    item = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w"))
    item = item.select("item", F.monotonically_increasing_id().alias("ref"), _shingles("w", k, _joined).alias("parts"))
    item = scratch.write(
        item.withColumn("n_item", F.size("parts")).where("n_item > 0").withColumn("hashes", F.array_sort(F.transform("parts", _hash_of_joined))),
        "items",
    )
    if item.limit(1).count() == 0:
        scratch.clear()
        return docs.sparkSession.createDataFrame([], _result_schema(docs, items, id_col, item_col, row_col))

    # a partition holds the sizes from 2^c to 2^(c+1) - 1; its sketch serves its largest size
    item = item.withColumn("largest", F.expr("shiftleft(2, cast(floor(log2(n_item)) AS INT)) - 1"))
    sketch = F.expr(f"largest - ({num} * largest + {den - 1}) DIV {den} + 1")
    needed = F.expr(f"({num} * n_item + {den - 1}) DIV {den}")
    sketches = scratch.write(
        item.select("ref", needed.alias("needed"), F.explode(F.slice("hashes", F.lit(1), F.least(sketch, F.col("n_item")).cast("int"))).alias("hash")),
        "sketches",
    )
    bounds = sketches.agg(F.count("*"), F.max("hash")).first()
    full_rows = item.agg(F.sum("n_item")).first()[0]

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    hashed = slim.select("id", row_hash("text").alias("row"), words(F.col("text")).alias("w")).select(
        "id", "row", F.size("w").alias("n_words"), _shingles("w", k, _hashed).alias("hashes")
    )
    low = hashed.select(
        "id", "row", F.size("hashes").alias("n_doc"), F.explode(F.filter("hashes", lambda h: h <= F.lit(bounds[1]))).alias("hash")
    )
    side = F.broadcast(sketches) if bounds[0] <= broadcast_rows else sketches
    candidates = low.join(side, "hash").where(F.col("n_doc") >= F.col("needed")).select("id", "row", "ref").distinct()
    candidates = scratch.write(candidates, "candidates")

    rows = candidates.select("id", "row").distinct()
    few = rows.count() <= broadcast_rows
    keyed = slim.withColumn("row", row_hash("text"))
    chosen = keyed.join(F.broadcast(rows) if few else rows, keyed["id"].eqNullSafe(rows["id"]) & (keyed["row"] == rows["row"]), "left_semi")
    parts = (
        chosen.dropDuplicates(["id", "row"]) if not few else chosen
    ).select("id", "row", words(F.col("text")).alias("w")).select("id", "row", F.explode(_shingles("w", k, _joined)).alias("part"))
    full = item.select("ref", F.explode("parts").alias("part"))
    full = F.broadcast(full) if full_rows <= broadcast_rows else full
    shared = parts.join(full, "part").groupBy("id", "row", "ref").agg(F.count_distinct("part").alias("n_shared"))
    found = candidates.alias("c").join(
        shared.alias("s"),
        F.col("c.id").eqNullSafe(F.col("s.id")) & (F.col("c.row") == F.col("s.row")) & (F.col("c.ref") == F.col("s.ref")),
    ).select("c.id", "c.row", "c.ref", "s.n_shared")
    sizes = item.select("ref", "item", "n_item")
    found = found.join(sizes, "ref").where(F.col("n_shared") * den >= F.col("n_item") * num)
    by_row = [F.col("row").alias(row_col)] if row_col else []
    out = (
        found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col), *by_row)
        .agg(F.max(F.struct("n_shared", "n_item")).alias("m"))
        .select(id_col, item_col, *([row_col] if row_col else []), "m.n_shared", F.col("m.n_item").cast("long").alias("n_item"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )
    out = scratch.write(out, "result", keep=True)
    scratch.clear()
    return out


def _hash_of_joined(part: Column) -> Column:
    """The same hash that ``_hashed`` gives for the words of a joined shingle."""
    return F.xxhash64(F.split(part, " "))


def row_hash(text_col: str) -> Column:
    """What tells rows with one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _result_schema(docs: DataFrame, items: DataFrame, id_col: str, item_col: str, row_col: str | None) -> str:
    a, b = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    row = f"`{row_col}` long, " if row_col else ""
    return f"`{id_col}` {a}, `{item_col}` {b}, {row}n_shared long, n_item long, containment double"


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns; null and repeated ids are judged row by row."""
    row = fresh(docs, "__row")
    leaks = find_leaks(docs, items, id_col=id_col, text_col=text_col, row_col=row, **how)
    keyed = docs.withColumn(row, row_hash(text_col))
    return drop_keys(keyed, leaks, {id_col: id_col, row: row}, Scratch(docs.sparkSession, "decontam")).select(*docs.columns)
