"""Cross-reference of part numbers to vendor numbers and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions.text import compact, drop_crimp_mark, strip_order_suffixes


def rules(spark) -> DataFrame:
    """Rule rows: about two hundred, fixed; always small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(R.rule_rows(), R.RULE_SCHEMA))


def vendor_number() -> Column:
    """The vendor's number from a decoded row joined to its rule row."""
    tail = F.concat("insert", "contact", "key")
    forms = {
        "prefix": F.concat("style", "size_number", F.lit("-"), tail),
        "letter": F.concat("base", "style", "class", "size", tail),
        "BL": F.concat("base", "style", "finish", "size_number", F.lit("-"), tail),
        "base": F.concat("base", F.lit("-"), "style", "finish", "size_padded", F.lit("-"), tail),
        "T": F.concat("base", "style", F.lit("T"), "size_number", "finish", tail),
        "8D": F.concat("base", "style", F.lit("-"), "size_padded", "finish", tail),
        "DTS": F.concat("base", "style", "finish", "size_number", tail),
        "ACT": F.concat("base", "style", "finish", "size", tail),
    }
    out = F.lit(None).cast("string")
    for fmt, form in forms.items():
        out = F.when(F.col("fmt") == fmt, form).otherwise(out)
    return out


def composite_only() -> Column:
    """A vendor's 1500-cycle contacts are documented for its composite classes alone."""
    return (F.col("vendor") == "Souriau") & F.col("contact").isin("H", "J") & ~F.col("class").isin("J", "M")


def convert_forward(parsed: DataFrame) -> DataFrame:
    """All vendor numbers of each decoded row: an equi-join with the rule rows on sheet and class, then list tests."""
    joined = parsed.where("error IS NULL").join(
        rules(parsed.sparkSession), (F.col("sheet") == F.col("rule_sheet")) & (F.col("class") == F.col("rule_class"))
    )
    fits = (
        ((F.col("sizes") == "") | F.expr("instr(sizes, size) > 0"))
        & F.expr("instr(contacts, contact) > 0")
        & F.expr("instr(keys, key) > 0")
        & ~composite_only()
    )
    return joined.where(fits).withColumn("vendor_pn", vendor_number()).drop("rule_sheet", "rule_class", "rule_series")


def unsupported_reasons(parsed: DataFrame) -> DataFrame:
    """(all columns, ``ord``, ``vendor``, ``line``, ``reason``) for every rule that a decoded row does not meet.

    The seventeen rules are an array literal that is exploded onto each row. The reason is
    the first failing test: series, sheet, size, contact, key, class, then the vendor's exception.
    """
    structs = []
    for o, vendor, line, _, series, _, sizes, contacts, keys, styles, finishes in R.RULES:
        structs.append(
            F.struct(
                F.lit(o).alias("ord"), F.lit(vendor).alias("vendor"), F.lit(line).alias("line"), F.lit(series).alias("s"),
                F.lit(sizes).alias("sizes"), F.lit(contacts).alias("contacts"), F.lit(keys).alias("keys"),
                F.array(*[F.lit(x) for x in styles]).alias("sheets"), F.array(*[F.lit(x) for x in finishes]).alias("classes"),
            )
        )
    df = parsed.where("error IS NULL").withColumn("r", F.explode(F.array(*structs)))
    no = lambda text: F.expr(text)
    reason = (
        F.when(no("series <> r.s"), "series not supported")
        .when(no("NOT array_contains(r.sheets, sheet)"), "shell type not supported")
        .when(no("r.sizes <> '' AND instr(r.sizes, size) = 0"), "shell size not supported")
        .when(no("instr(r.contacts, contact) = 0"), "contact not supported")
        .when(no("instr(r.keys, key) = 0"), "key position not supported")
        .when(no("NOT array_contains(r.classes, class)"), "finish/class not supported")
        .when(no("r.vendor = 'Souriau' AND contact IN ('H', 'J') AND class NOT IN ('J', 'M')"), "contact only for composite classes")
    )
    out = df.withColumn("reason", reason).where("reason IS NOT NULL")
    return out.select(*parsed.columns, "r.ord", "r.vendor", "r.line", "reason")


def _head() -> Column:
    """What a vendor number starts with under a rule row, without hyphens; what follows is size, insert, contact, key."""
    x = (
        F.when(F.col("fmt") == "prefix", F.concat("style", "finish"))
        .when(F.col("fmt") == "letter", F.concat("base", "style", "rule_class"))
        .when(F.col("fmt") == "T", F.concat("base", "style", F.lit("T")))
        .when(F.col("fmt") == "8D", F.concat("base", "style"))
        .otherwise(F.concat("base", "style", "finish"))
    )
    return F.replace(x, F.lit("-"), F.lit(""))


def _heads(spark) -> DataFrame:
    """The rule rows with their ``head``; a crimp prefix once more without its R, as the head of its board variant (``board``)."""
    crimp = spark.createDataFrame(R.rule_rows(), R.RULE_SCHEMA).withColumn("crimp", _head())
    board = crimp.where("fmt = 'prefix'").withColumn("head", drop_crimp_mark("crimp")).where("head <> crimp")
    return crimp.select("*", F.col("crimp").alias("head"), F.lit(False).alias("board")).unionByName(board.withColumn("board", F.lit(True)))


def convert_reverse(numbers: DataFrame, col: str = "vendor_pn") -> DataFrame:
    """(all columns, ``ord``, ``vendor``, ``normalized``): every standard number that a vendor number can stand for.

    Hyphens, blanks, case and ordering suffixes do not matter. The prefix join is an
    equi-join: each number offers its first 4 to 9 characters, each rule row its head, and
    they meet on equal strings. The rest must be a size (letter or number by format, the
    longer number first), an insert of one or two digits, a contact and a key (N if missing
    for the formats that allow it), and the rule must support contact, key and size.

    Numbers of the prefix format may have three insert digits and need no support of the rule. One
    that does not start with the crimp prefix, but with it less its R, is a board variant: marks for
    quadrax (GQ, RQ) and then for the termination (CI, LI, G, Q) stand before its size.
    """
    spark = numbers.sparkSession
    heads = _heads(spark)
    lengths = [r[0] for r in heads.select(F.length("head")).distinct().collect()]  # a handful: the rules are fixed
    x = numbers.withColumn("__x", strip_order_suffixes(F.regexp_replace(F.upper(F.col(col)), r"\s+", "")))
    x = x.withColumn("__x", compact("__x"))
    x = x.withColumn("head", F.explode(F.array(*[F.substring("__x", 1, n) for n in sorted(lengths)])))
    j = x.join(F.broadcast(heads), "head").where(~F.col("board") | ~F.startswith("__x", F.col("crimp")))
    optional = F.col("fmt").isin("prefix", "BL", "base")
    nums = "|".join(sorted(["09", *[n for _, n in R.SHELL_SIZES]], key=lambda n: (-len(n), n)))
    rest = F.expr("substring(__x, length(head) + 1)")
    rest = F.when(F.col("board"), F.regexp_replace(F.regexp_replace(rest, "^(GQ|RQ)", ""), "^(CI|LI|G|Q)", "")).otherwise(rest)

    def fields(pattern: str, digits: int = 2) -> Column:
        tail = rf"(\d{{1,{digits}}})([A-Z])([A-Z])?$"
        return F.split(F.regexp_replace(rest, "^" + pattern + tail, "$1,$2,$3,$4,$5"), ",")

    read = (
        F.when(F.col("fmt").isin("letter", "ACT"), fields(r"([A-HJ])()"))
        .when(F.col("fmt").isin("T", "8D"), fields(rf"({nums})([A-Z])"))
        .when(F.col("fmt") == "prefix", fields(rf"({nums})()", 3))
        .otherwise(fields(rf"({nums})()"))
    )
    # one pattern a row, read once: the generator keeps the tests below from repeating it
    whole = F.filter(F.array(read), lambda p: (F.size(p) == 5) & (F.instr("__x", ",") == 0))
    j = j.withColumn("__p", F.explode(whole))

    def group(i: int) -> Column:
        return F.get("__p", F.lit(i - 1))

    size_map = F.create_map(*[F.lit(v) for c, n in R.SHELL_SIZES for v in (n, c)], F.lit("09"), F.lit("A"))
    j = (
        j.withColumn("size", F.when(F.col("fmt").isin("letter", "ACT"), group(1)).otherwise(F.try_element_at(size_map, group(1))))
        .withColumn("__finish", group(2))
        .withColumn("insert", group(3))
        .withColumn("contact", group(4))
        .withColumn("__key", group(5))
        .withColumn("key", F.when(F.col("__key") != "", F.col("__key")).when(optional, F.lit("N")))
        .withColumnRenamed("rule_sheet", "sheet")
        .withColumnRenamed("rule_class", "class")
    )
    supported = ((F.col("sizes") == "") | F.expr("instr(sizes, size) > 0")) & F.expr("instr(contacts, contact) > 0") & F.expr("instr(keys, key) > 0") & ~composite_only()
    fits = (
        (F.col("insert") != "")
        & F.col("key").isNotNull()
        & F.col("size").isNotNull()
        & (~F.col("fmt").isin("T", "8D") | (F.col("__finish") == F.col("finish")))
        & ((F.col("fmt") == "prefix") | supported)
    )
    out = j.where(fits).withColumn("normalized", F.concat(F.lit("D38999/"), "sheet", "class", "size", "insert", "contact", "key"))
    return out.select(*numbers.columns, "ord", "vendor", "normalized").distinct()
