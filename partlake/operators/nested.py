"""Nested catalog records: contact notes, labelled contacts, sources, examples, documents in documents.

Notes are arrays of (count, size); everything is a function over arrays inside a row, so
nothing shuffles until rows are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.operators.electrical import rating


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def size_summary(notes) -> Column:
    """``3x #22D, 2x #8 Coax``; unknown without notes."""
    text = F.array_join(F.transform(_c(notes), lambda n: F.concat(n["count"].cast("string"), F.lit("x #"), n["size"])), ", ")
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(text)


def contact_amps(size: Column) -> Column:
    """Rating of a size as written, else of its first word unless it is a data contact; null for none."""
    base = rating(F.regexp_extract(F.trim(size), r"^(\S*)", 1))
    return F.coalesce(rating(F.trim(size)), F.when(~F.lower(size).rlike("coax|twinax"), base))


def max_amps(notes) -> Column:
    """The best rating among the notes, 0 without any."""
    return F.coalesce(F.array_max(F.transform(_c(notes), lambda n: contact_amps(n["size"]))), F.lit(0.0))


def meets_current(notes, amps: float) -> Column:
    """Whether one contact carries the load; no load is met by all."""
    return F.lit(True) if not amps else max_amps(notes) >= amps


def amps_text(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def current_summary(notes) -> Column:
    """Rated sizes, strongest first, ties in their order."""
    rated = F.filter(
        F.transform(_c(notes), lambda n, i: F.struct((-contact_amps(n["size"])).alias("a"), i.alias("i"), n["size"].alias("size"))), lambda x: x["a"] < 0
    )
    sorted_ = F.array_sort(rated)
    parts = F.array_join(F.transform(sorted_, lambda x: F.concat(F.lit("#"), x["size"], F.lit(" = "), amps_text(-x["a"]), F.lit(" A"))), ", ")
    text = F.concat(F.lit("up to "), amps_text(-F.get(sorted_, F.lit(0))["a"]), F.lit(" A/contact ("), parts, F.lit(")"))
    return F.when(F.size(rated) > 0, text).otherwise("RF / data contacts only (no power rating)")


def thresholds(df: DataFrame, notes: str) -> DataFrame:
    """(amps): the different ratings that occur, ascending; one shuffle of a handful of values."""
    amps = df.select(F.explode(F.transform(notes, lambda n: contact_amps(n["size"]))).alias("amps"))
    return amps.where("amps > 0").distinct().orderBy("amps")


def contact_keys(labels) -> Column:
    """A key for each contact of an array of labels: the label, ``label__position`` where it repeats, ``#position`` without one."""
    x = _c(labels)
    named = lambda v: v.isNotNull() & (v != "") & (v != "?")

    def key(v: Column, i: Column) -> Column:
        place = (i + 1).cast("string")
        again = F.size(F.filter(x, lambda w: w == v)) > 1
        return F.when(~named(v), F.concat(F.lit("#"), place)).when(again, F.concat(v, F.lit("__"), place)).otherwise(v)

    return F.transform(x, lambda v, i: key(v, i))


def flatten_contacts(df: DataFrame, id_col: str, labels: str) -> DataFrame:
    """(id, position from 1, label, key): one row a contact, as written to the contact list."""
    both = F.arrays_zip(F.col(labels).alias("label"), contact_keys(labels).alias("key"))
    out = df.select(id_col, F.posexplode(both).alias("p", "c"))
    return out.select(id_col, (F.col("p") + 1).alias("position"), "c.label", "c.key")


def append_unique(items, value: Column) -> Column:
    """The array with the value at its end, unless an equal one is in it; structs compare by their fields."""
    x = _c(items)
    return F.when(F.coalesce(F.array_contains(x, value), F.lit(False)), x).otherwise(F.concat(x, F.array(value)))


def source_bits(manufacturers, lists, sources) -> Column:
    """What names a part: manufacturers, qualification lists, then each source in words of its kind; repeats go.

    ``sources`` is an array of (kind, citation, pdf, page, list).
    """

    def words(s: Column) -> Column:
        page = F.concat_ws(" ", s["pdf"], F.concat(F.lit("page "), s["page"].cast("string")))
        return (
            F.when(s["kind"] == "verified", s["citation"])
            .when(s["kind"] == "example", page)
            .when(s["kind"] == "secondary", "secondary index")
            .when(s["kind"] == "list", F.concat(F.lit("QPL "), s["list"]))
        )

    qpl = F.transform(_c(lists), lambda q: F.concat(F.lit("QPL "), q))
    bits = F.concat(_c(manufacturers), qpl, F.transform(_c(sources), words))
    return F.array_distinct(F.filter(bits, lambda b: b.isNotNull() & (b != "")))


def example_parts(examples, verified, top: int = 3) -> Column:
    """The first ``top`` of the examples, or of the verified parts where there are none, with the description that a verified part of that number has."""
    v = _c(verified)
    described = lambda pn: F.coalesce(F.get(F.filter(v, lambda x: x["pn"] == pn), F.lit(0))["description"], F.lit(""))
    plain = F.transform(_c(examples), lambda pn: F.struct(pn.alias("pn"), described(pn).alias("description")))
    rich = F.transform(v, lambda x: F.struct(x["pn"].alias("pn"), F.coalesce(x["description"], F.lit("")).alias("description")))
    return F.slice(F.when(F.size(plain) > 0, plain).otherwise(rich), 1, top)


#: The space separators of Unicode, which SQL engines trim.
_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def split_batch(text) -> Column:
    """Entries of a pasted list: split at line ends, semicolons and tabs, trimmed of blanks, empty ones dropped."""
    # a lambda of one argument: ``F.trim`` itself would take an entry's number as the characters to trim
    return F.filter(F.transform(F.split(_c(text), r"\r?\n|;|\t"), lambda x: F.trim(x, F.lit(_BLANKS))), lambda x: x != "")


def canonical_json(text) -> Column:
    """A flat JSON object with its keys in order and no blanks; equal objects give equal texts. Null where it does not parse."""
    entries = F.map_entries(F.from_json(_c(text), "map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def compact_record(**fields: Column) -> Column:
    """JSON of the fields that are there: nulls, empty texts and empty arrays are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"})


SECTIONS = ("standard", "rugged", "accessory")
FAMILY = "array<struct<family:string,parts:array<struct<pn:string,verified:boolean>>>>"


def collect_parts(df: DataFrame, id_col: str, doc: str) -> DataFrame:
    """(id, section, family, pn): verified parts of a JSON document of sections, families and parts, each with its family's name."""
    doc_type = "struct<" + ",".join(f"{s}:{FAMILY}" for s in SECTIONS) + ">"
    parsed = df.select(id_col, F.from_json(doc, doc_type).alias("d"))
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"d.{s}").alias("families")) for s in SECTIONS])
    families = parsed.select(id_col, F.explode(sections).alias("s")).select(id_col, "s.section", F.explode("s.families").alias("f"))
    parts = families.select(id_col, "section", "f.family", F.explode("f.parts").alias("p")).where("p.verified")
    return parts.select(id_col, "section", "family", "p.pn")


def rule_classes(rules: DataFrame) -> DataFrame:
    """(ord, classes, sizes): each rule's class codes in order, and its shell sizes, all where it names none."""
    every = "".join(c for c, _ in R.SHELL_SIZES)
    return rules.groupBy("ord").agg(
        F.array_sort(F.collect_set("rule_class")).alias("classes"), F.first(F.when(F.col("sizes") == "", every).otherwise(F.col("sizes"))).alias("sizes")
    )
