"""Part-number parsing: columns in, typed columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions.text import canonical, compact, normal_key


def _map(pairs: list[tuple]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


SERIES = [(s, "III") for s in R.SERIES_III] + [(s, "IV") for s in R.SERIES_IV]
_BODY = r"^D38999/(\d{2})(" + "|".join(sorted(R.CLASSES, key=lambda c: (-len(c), c))) + r")([A-HJ])(\d{1,2})([A-Z])([A-Z])?$"


def parse_strict(df: DataFrame, col: str = "raw_pn") -> DataFrame:
    """Add ``normalized`` and the parts of a Series III/IV part number, and ``error`` (null when it parses).

    Blanks, hyphens and case do not matter; a missing key is N. The class is the longest
    known one whose rest parses. Errors, first one wins: ``not a pin``, ``unsupported sheet``,
    ``class not parsed``.
    """
    df = df.withColumn("__pn", compact(col))
    df = df.withColumn("__sheet", F.regexp_extract("__pn", r"^D38999/(\d{2})[A-Z0-9]+$", 1))
    known = F.col("__sheet").isin([s for s, _ in SERIES])
    # the pattern runs once a row: its groups become one array
    groups = F.split(F.regexp_replace("__pn", _BODY, "$1,$2,$3,$4,$5,$6"), ",")
    df = df.withColumn("__g", F.when(known & F.col("__pn").rlike(_BODY), groups))
    parts = {name: F.get("__g", F.lit(i)) for i, name in enumerate(["sheet", "class", "size", "insert", "contact"])}
    key = F.get("__g", F.lit(5))
    df = df.withColumns({**parts, "key": F.when(key == "", "N").otherwise(key)})
    return df.withColumns(
        {
            "series": F.when(F.col("sheet") < "40", "III").when(F.col("sheet") >= "40", "IV"),
            "size_number": F.try_element_at(_map(R.SHELL_SIZES), F.col("size")),
            "size_padded": F.lpad(F.try_element_at(_map(R.SHELL_SIZES), F.col("size")), 2, "0"),
            "normalized": F.concat(F.lit("D38999/"), "sheet", "class", "size", "insert", "contact", "key"),
            "error": F.when(F.coalesce("__sheet", F.lit("")) == "", "not a pin")
            .when(~F.col("__sheet").isin([s for s, _ in SERIES]), "unsupported sheet")
            .when(F.col("__g").isNull(), "class not parsed"),
        }
    ).drop("__pn", "__sheet", "__g")


# --- fixed values: grammars in order of precedence, with the names of their groups
GRAMMARS = [
    ("standard", r"^D38999/(\d{2})([A-Z])([A-Z]{1,2})(\d{1,3})([A-Z])([A-Z])$", ["sheet", "class", "size", "insert", "contact", "key"]),
    ("lanyard", r"^D38999/(31|36)([A-Z])([A-Z])(\d{1,3})([A-Z])([A-Z])(\d)$", ["sheet", "class", "lanyard", "insert", "contact", "key", "type"]),
    ("dummy", r"^D38999/(22|50)([A-HJ]\d?)([A-Z])$", ["sheet", "size", "class"]),
    ("cover", r"^D38999/(32|33|51|52)([A-Z])(\d{1,2})([A-Z])$", ["sheet", "class", "number", "key"]),
]
FIELDS = ["sheet", "class", "size", "insert", "contact", "key", "lanyard", "type"]


def decode_grammars(df: DataFrame, col: str = "raw_pn") -> DataFrame:
    """Add ``grammar`` (null when none matches), the fields it gives and ``valid``.

    White space and case do not matter, hyphens do. Lanyard shells have size J; covers give
    their size as a number, unknown numbers an empty code. Valid numbers have a documented
    contact letter and a plain size letter, where they have these at all.
    """
    df = df.withColumn("__pn", canonical(col))
    grammar = F.lit(None).cast("string")
    for name, pattern, _ in reversed(GRAMMARS):
        grammar = F.when(F.col("__pn").rlike(pattern), F.lit(name)).otherwise(grammar)
    df = df.withColumn("grammar", grammar)
    numbers = _map([(n, c) for c, n in R.SHELL_SIZES])
    for f in FIELDS:
        out = F.lit(None).cast("string")
        for name, pattern, groups in GRAMMARS:
            if f in groups:
                got = F.regexp_extract("__pn", pattern, groups.index(f) + 1)
            elif f == "size" and name == "lanyard":
                got = F.lit("J")
            elif f == "size" and name == "cover":
                got = F.coalesce(F.try_element_at(numbers, F.regexp_extract("__pn", pattern, groups.index("number") + 1)), F.lit(""))
            else:
                continue
            out = F.when(F.col("grammar") == name, got).otherwise(out)
        df = df.withColumn(f, out)
    contact_ok = F.col("contact").isNull() | F.col("contact").isin(*R.KNOWN_CONTACT_LETTERS)
    size_ok = F.col("size").isNull() | (F.col("size") == "") | F.col("size").isin(*[c for c, _ in R.SHELL_SIZES])
    return df.withColumn("valid", F.col("grammar").isNotNull() & contact_ok & size_ok).drop("__pn")


def odd_bucket(col: str) -> Column:
    """Why a part number is not a canonical Series III/IV one; null when it is."""
    x = compact(col)
    sheet, body = F.regexp_extract(x, r"^D38999/(\d{2})(.*)$", 1), F.regexp_extract(x, r"^D38999/(\d{2})(.*)$", 2)
    known = sheet.isin([s for s, _ in SERIES])
    return (
        F.when(known & x.rlike(r"^D38999/\d{2}[A-Z]{1,2}[A-HJ]\d{1,3}[A-Z][A-Z]?$"), F.lit(None).cast("string"))
        .when(x.startswith("MS") | x.startswith("M38999"), "legacy series")
        .when(sheet == "", "other standard")
        .when(~known, "other sheet")
        .when(body.rlike(r"^[A-Z]{1,2}\d"), "numeric shell size")
        .when(body.rlike(r"^[A-Z]{1,2}[A-HJ]\d{1,3}[A-Z][A-Z]?.+$"), "trailing variant")
        .when(~body.rlike(r"\d"), "partial")
        .otherwise("other")
    )


def key_of(col: str) -> Column:
    return normal_key(col)


def part_number(sheet: str, cls: str, size: str, insert: str, contact, key: str) -> Column:
    """Parts back to a normalized number."""
    return F.concat(F.lit("D38999/"), F.col(sheet), F.col(cls), F.col(size), F.col(insert), contact, F.col(key))


def decode_scored(df: DataFrame, col: str, known_inserts: list[str]) -> DataFrame:
    """Add ``pin``, ``key_given`` and ``score`` of the better of two readings: last letter as key, or as contact with key N.

    10 for an insert number that is known, 2 for a given key or 1 for the default. Ties go
    to the first reading; neither fits: null.
    """
    df = df.withColumn("__pn", compact(col))
    head = r"^D38999/(\d{2})(AA|AB|[A-Z])([A-HJ])(\d{1,3})"
    readings = []
    for given, tail in ((True, r"([A-Z])([A-Z])$"), (False, r"([A-Z])$")):
        g = F.split(F.regexp_replace("__pn", head + tail, "$1,$2,$3,$4,$5" + (",$6" if given else ",N")), ",")
        score = F.when(F.get(g, F.lit(3)).isin(known_inserts), 10).otherwise(0) + F.lit(2 if given else 1)
        pin = F.concat(F.lit("D38999/"), F.array_join(g, ""))
        readings.append(F.when(F.col("__pn").rlike(head + tail), F.struct(pin.alias("pin"), F.lit(given).alias("key_given"), score.alias("score"))))
    a, b = readings
    best = F.when(a.isNull() | (b["score"] > a["score"]), F.coalesce(b, a)).otherwise(a)
    df = df.withColumn("__best", best)
    return df.select(*[c for c in df.columns if not c.startswith("__")], "__best.pin", "__best.key_given", "__best.score")
