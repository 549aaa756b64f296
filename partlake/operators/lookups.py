"""Lookups with alternatives: either of two codes, precedence, raw or normal ids, comparison, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.functions.labels import arrangement_id


def join_either(left: DataFrame, key: str, right: DataFrame, codes: list[str], row_id: str) -> DataFrame:
    """Pairs where the key equals any of the right side's codes; a row with two equal codes meets once.

    The OR is written as an equi-join on the exploded codes, so it hashes instead of looping.
    """
    each = right.withColumn("__code", F.explode(F.array_distinct(F.array_compact(F.array(*codes)))))
    return left.join(each, left[key] == each["__code"]).drop("__code")


def support_rows(decoded: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows for decoded numbers: style code or equivalent is the sheet, contact and key are listed where there are lists."""
    met = join_either(decoded, "sheet", catalog, ["style", "equivalent"], "row_id")
    listed = lambda xs, x: (F.size(xs) == 0) | F.array_contains(xs, F.col(x))
    return met.where(listed(F.col("contacts"), "contact") & listed(F.col("keys"), "key"))


def supported_sources(decoded: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, ``sources``): the catalogs that support each number, none for those without. Catalog rows that ask for the same are joined once."""
    alike = catalog.groupBy("style", "equivalent", "contacts", "keys", "source").agg(F.min("row_id").alias("row_id"))
    met = support_rows(decoded, alike).groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return decoded.select(key).distinct().join(met, key, "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def prefer(df: DataFrame, key: str, rank: list) -> DataFrame:
    """The row of each key that comes first by the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*rank))).where("__rn = 1").drop("__rn")


def approved_only(docs: DataFrame, key: str, order: str, series: list[str]) -> DataFrame:
    """The first document of each key that is no draft and of one of the series; drafts are never used."""
    fit = docs.where(~F.col("draft") & F.col("series").isin(series))
    return fit.groupBy(key).agg(F.min_by(F.struct(*[c for c in docs.columns if c != key]), order).alias("d")).select(key, "d.*")


def lookup_arrangement(asked: DataFrame, col: str, arrangements: DataFrame, order: str) -> DataFrame:
    """(col, arrangement columns): the first arrangement whose id is the text or its normal form."""
    q = asked.select(col).distinct().withColumn("__k", F.explode(F.array_distinct(F.array(F.col(col), arrangement_id(col)))))
    met = q.join(arrangements, q["__k"] == arrangements["id"])
    return met.groupBy(col).agg(F.min_by(F.struct(*arrangements.columns), order).alias("a")).select(col, "a.*")


def compare_two(df: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """(field, left, right, same): two rows side by side, one line a field; the table is read once."""
    fields = [c for c in df.columns if c != key]
    both = df.where((F.col(key) == a) | (F.col(key) == b)).agg(
        *[F.max(F.when(F.col(key) == side, F.col(c).cast("string"))).alias(f"{n}_{c}") for n, side in (("a", a), ("b", b)) for c in fields]
    )
    lines = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("left"), F.col(f"b_{c}").alias("right")) for c in fields])
    out = both.select(F.explode(lines).alias("l")).select("l.*")
    return out.withColumn("same", F.col("left").eqNullSafe(F.col("right")))


def review_queue(df: DataFrame, id_col: str, issues: dict[str, Column]) -> DataFrame:
    """(id, ``issues``): rows with something to look at."""
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in issues.items()]))
    return df.select(id_col, found.alias("issues")).where(F.size("issues") > 0)


def with_defaults(df: DataFrame, keys: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """A row for every key: its record, or the empty one with the given defaults."""
    out = keys.select(key).distinct().join(df, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), v).alias(c) for c, v in defaults.items()])


def exact_hits(df: DataFrame, col: str, word: Column) -> DataFrame:
    """Search hits that are the word itself, in any case."""
    return df.where(F.lower(F.trim(col)) == F.lower(F.trim(word)))


def evidence_text(status: Column, sources: Column, reasons: Column, most: int = 220) -> Column:
    """Sources of an exact match, else reasons, else sources, shortened; a fixed text for neither."""
    from partlake.functions.labels import is_exact_status
    from partlake.functions.text import summarize

    s, r = F.array_join(F.array_distinct(sources), " | "), F.array_join(F.array_distinct(reasons), " | ")
    text = (
        F.when(is_exact_status(status) & (s != ""), F.concat(F.lit("Validation sources: "), s))
        .when(r != "", r)
        .when(s != "", F.concat(F.lit("Sources: "), s))
    )
    return F.coalesce(summarize(text, most), F.lit("Validation source is not available."))


def other_role(df: DataFrame, family: str, role: str, number: str, top: int) -> DataFrame:
    """(all columns, ``mate``, ``place``): numbers of the same family and the opposite role, verified ones first, then by number; ``top`` of each.

    A role's best ``top`` are found per family first, so the join sees ``top`` rows of a role and family.
    """
    w = Window.partitionBy(family, role).orderBy(F.desc("verified"), number)
    best = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    right = best.select(F.col(family).alias("__f"), F.col(role).alias("__r"), F.col(number).alias("mate"), "place")
    return df.join(right, (F.col(family) == F.col("__f")) & (F.col(role) != F.col("__r"))).drop("__f", "__r")
