"""What a number is and what it converts to: rugged family, standard number, vendor number or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators import convert, decode, rugged
from partlake.scratch import Scratch


def convert_any(df: DataFrame, col: str) -> DataFrame:
    """(col, ``mode``, ``normalized``, ``vendor``): one row for each reading of each different number.

    Rugged families go first, then standard numbers; only what is neither goes through the
    reverse conversion, so its joins see no others. ``error`` rows have no reading. A null
    number is an error.
    """
    # hung on a count, so that the parse is not copied into filters below the shuffle; a max of texts would sort them
    once = df.groupBy(F.col(col).alias("__k")).agg(F.count("*").alias("__n")).select(F.when(F.col("__n") > 0, F.col("__k")).alias(col))
    marked = rugged.recognise(once, col).select(col, F.col("family").isNotNull().alias("is_rugged"))
    parsed = decode.parse_strict(marked, col).select(col, "is_rugged", "error", "normalized")
    none = F.lit(None).cast("string")
    mode = F.when(F.col("is_rugged"), "rugged").when(F.col("error").isNull(), "standard")
    # written, as each of the branches below would parse every number again
    scratch = Scratch(df.sparkSession, "convert-any")
    first = scratch.write(parsed.select(col, mode.alias("mode"), "normalized"), "parsed", keep=True)
    known = first.where("mode IS NOT NULL").select(col, "mode", F.when(F.col("mode") == "standard", F.col("normalized")).alias("normalized"), none.alias("vendor"))
    rest = first.where("mode IS NULL").select(col)
    back = convert.convert_reverse(rest.where(F.col(col).isNotNull()), col).select(col, "normalized", "vendor").distinct()
    back = scratch.write(back, "read", keep=True)
    read = back.select(col, F.lit("vendor").alias("mode"), "normalized", "vendor")
    lost = rest.join(back, rest[col].eqNullSafe(back[col]), "left_anti").select(col, F.lit("error").alias("mode"), none.alias("normalized"), none.alias("vendor"))
    return known.unionByName(read).unionByName(lost)


def ranked_reverse(numbers: DataFrame, col: str = "vendor_pn") -> DataFrame:
    """(col, ``place``, ``vendor``, ``normalized``): readings of each vendor number by vendor, then standard number; all count as equally sure."""
    back = convert.convert_reverse(numbers, col).select(col, "vendor", "normalized").distinct()
    return back.withColumn("place", F.row_number().over(Window.partitionBy(col).orderBy("vendor", "normalized")))


def batch_decode(df: DataFrame, col: str) -> DataFrame:
    """(col, ``ok``, ``normalized``, ``source``): each different entry by itself, else by its first reading as a vendor number."""
    read = convert_any(df, col).where("mode <> 'rugged'")
    best = read.groupBy(col).agg(F.min(F.struct(F.col("vendor").isNotNull().alias("v"), "vendor", "normalized")).alias("b"), F.min("mode").alias("mode"))
    ok = F.col("mode") != "error"
    return best.select(col, ok.alias("ok"), F.col("b.normalized").alias("normalized"), F.when(ok, F.coalesce("b.vendor", F.lit("standard"))).alias("source"))


def connector_blocks(parsed: DataFrame) -> DataFrame:
    """(normalized, sheet, size_number, description, ``vendors`` array of (vendor, line, number)): a report block for each decoded number."""
    parts = ["normalized", "error", "sheet", "class", "size", "size_number", "size_padded", "insert", "contact", "key"]
    once = parsed.where("error IS NULL").select(*parts).distinct()
    rows = convert.convert_forward(once).groupBy("normalized").agg(F.array_sort(F.collect_list(F.struct("vendor", "line", "vendor_pn"))).alias("vendors"))
    text = F.try_element_at(F.create_map(*[F.lit(x) for p in R.SHEET_DESCRIPTIONS for x in p]), F.col("sheet"))
    out = once.join(rows, "normalized", "left")
    empty = F.array().cast("array<struct<vendor:string,line:string,vendor_pn:string>>")
    return out.select("normalized", "sheet", "size_number", F.coalesce(text, "sheet").alias("description"), F.coalesce("vendors", empty).alias("vendors"))


def rule_signature() -> Column:
    """The text that a vendor's catalog must have for a rule row: what its numbers start with."""
    return F.when(F.col("base") != "", F.col("base")).otherwise(F.regexp_replace("style", "-$", ""))


def layout_pattern() -> Column:
    """A pattern of a rule row's numbers, written down apart from the conversion, to test it."""
    tail = r"\d{1,2}[A-Z]{2}$"
    quoted = F.regexp_replace("style", "-", "[-]")
    return (
        F.when(F.col("fmt") == "prefix", F.concat(F.lit("^"), quoted, F.lit(r"\d{1,2}-"), F.lit(tail)))
        .when(F.col("fmt") == "letter", F.concat(F.lit("^"), "base", "style", "rule_class", F.lit("[A-HJ]"), F.lit(tail)))
        .when(F.col("fmt") == "ACT", F.concat(F.lit("^"), "base", "style", "finish", F.lit("[A-HJ]"), F.lit(tail)))
        .when(F.col("fmt") == "base", F.concat(F.lit("^"), "base", F.lit("-"), "style", "finish", F.lit(r"\d{2}-"), F.lit(tail)))
        .when(F.col("fmt") == "BL", F.concat(F.lit("^"), "base", "style", "finish", F.lit(r"\d{1,2}-"), F.lit(tail)))
        .when(F.col("fmt") == "T", F.concat(F.lit("^"), "base", "style", F.lit(r"T\d{1,2}"), "finish", F.lit(tail)))
        .when(F.col("fmt") == "8D", F.concat(F.lit("^"), "base", "style", F.lit(r"-\d{2}"), "finish", F.lit(tail)))
        .otherwise(F.concat(F.lit("^"), "base", "style", "finish", F.lit(r"\d{1,2}"), F.lit(tail)))
    )
