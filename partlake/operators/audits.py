"""Audits of a catalog: arrangements, numbers against the published pattern, families, other sources; and texts that sum a part up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions import labels, text
from partlake.operators import quality, rugged
from partlake.operators.decode import _BODY

_CODES = [c for c, _ in R.SHELL_SIZES]


# --- arrangements -----------------------------------------------------------------------
def check_arrangements(arrangements: DataFrame, contacts: DataFrame, rated: list[str], n_arrangements: int | None = None, n_contacts: int | None = None) -> DataFrame:
    """(check, n_rows, n_bad, status): what must hold of arrangements and their contacts.

    Arrangements have (id, shell, code, number, contact_count, expected_count), contacts (id, label, x, y,
    size). Ids are unique and read shell-number; a known shell code means that shell; counts agree
    with the contacts that are there; labels are there and unique in an arrangement; contacts have a
    place and a rated size; with ``n_arrangements`` and ``n_contacts``, there are so many.
    """
    sizes = F.create_map(*[F.lit(x) for pair in R.SHELL_SIZES for x in pair])
    known = F.try_element_at(sizes, F.col("code"))
    per = contacts.groupBy(F.col("id").alias("__id")).agg(
        F.count("*").alias("n"), (F.count_distinct("label") + F.max(F.col("label").isNull().cast("int"))).alias("n_labels"), F.count_if(F.col("label").isNull() | F.col("label").isin("", "?")).alias("n_blank")
    )
    a = arrangements.join(per, F.col("id").eqNullSafe(F.col("__id")), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_labels", "n_blank")})
    of_rows = quality.check_rows(
        a,
        {
            "id reads shell-number": F.col("id") == F.concat_ws("-", "shell", "number"),
            "shell is its code's": known.isNull() | (known == F.col("shell")),
            "contacts as counted": F.col("contact_count") == F.col("n"),
            "contacts as expected": F.col("expected_count").isNull() | (F.col("expected_count") == F.col("n")),
            "labels there": F.col("n_blank") == 0,
            "labels unique": F.col("n_labels") == F.col("n"),
        },
    )
    of_contacts = quality.check_rows(contacts, {"contact placed": F.col("x").isNotNull() & F.col("y").isNotNull(), "contact size rated": F.col("size").isin(rated)})
    out = of_rows.unionByName(quality.unique_key(arrangements, ["id"], "id unique")).unionByName(of_contacts)
    for name, df, n in (("number of arrangements", arrangements, n_arrangements), ("number of contacts", contacts, n_contacts)):
        if n is not None:
            one = df.agg(F.count("*").alias("n_rows")).withColumn("n_bad", F.abs(F.col("n_rows") - n))
            out = out.unionByName(one.select(F.lit(name).alias("check"), "n_rows", "n_bad", F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL").alias("status")))
    return out


# --- numbers ----------------------------------------------------------------------------
def check_numbers(df: DataFrame, number: str, classes: list[str], contacts: list[str]) -> DataFrame:
    """Add ``kind`` (insert, accessory, variant) and ``problem`` (null where the number is right).

    ``df`` has the decoded fields sheet, class, size, contact, key, lanyard and type. Numbers of
    accessory sheets are accessories; others with a lanyard length or a type are variants; the rest
    must have the published pattern and read like their fields. The first problem is told.
    """
    lead = F.regexp_extract(number, r"^D38999/(\d{2})", 1)
    fits = F.col(number).rlike(_BODY)
    group = lambda i: F.regexp_extract(number, _BODY, i)
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = F.when(lead.isin(R.ACCESSORY_SHEETS), "accessory").when(there("lanyard") | there("type"), "variant").otherwise("insert")
    bad_class = there("class") & ~F.col("class").isin(classes)
    bad_size = there("size") & ~F.col("size").isin(_CODES)
    differs = lambda i, c: F.col(c).isNotNull() & (group(i) != F.col(c))
    insert = F.when(~fits, "no insert pattern")
    for i, c in ((2, "class"), (3, "size"), (5, "contact"), (6, "key")):
        insert = insert.when(differs(i, c), f"{c} differs")
    insert = insert.when(~group(2).isin(classes), "unknown class").when(~group(5).isin(contacts), "contact not documented")
    problem = (
        F.when(F.coalesce(lead, F.lit("")) == "", "no sheet")
        .when(there("sheet") & (lead != F.col("sheet")), "sheet differs")
        .when((kind == "accessory") & bad_class, "unknown class")
        .when(kind == "variant", F.when(bad_size, "unknown size").when(bad_class, "unknown class"))
        .when(kind == "insert", insert)
    )
    return df.withColumns({"kind": kind, "problem": problem})


def check_families(df: DataFrame, number: str, families: list[tuple]) -> DataFrame:
    """(all columns, ``family``, ``verdict``): whether a verified number falls into its own base number's family.

    ``families`` are as for ``rugged.recognise``. A verdict is not recognised, other series (its base
    number is a family's prefix, but another one matched), unknown base (it is none's) or ok.
    """
    prefixes = [p.replace("-", "").replace(" ", "").upper() for _, p, _, _ in families]
    base = F.regexp_extract(number, r"^(\d{3}-\d{3})", 1)
    plain = F.replace(base, F.lit("-"), F.lit(""))
    met = rugged.recognise(df, number, families)
    own = F.create_map(*[F.lit(x) for _, p, f, _ in families for x in (f, p.replace("-", "").replace(" ", "").upper())])
    matched = F.try_element_at(own, F.col("family"))
    verdict = (
        F.when(F.col("family").isNull(), "not recognised")
        .when((base == "") | (matched == plain), "ok")
        .when(plain.isin(prefixes), "other series")
        .otherwise("unknown base")
    )
    return met.select(*df.columns, "family", verdict.alias("verdict"))


def cross_check(entries: DataFrame, verified: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(all columns, ``verified``, ``maker``, ``sources``, ``importable``) of entries decoded to sheet, contact, position.

    Entries have (key, sheet, contact, position), verified numbers (key, maker), catalog rows (sheet,
    contacts, positions, source) with arrays. An entry is importable where a catalog row lists its contact
    and its position. What is asked of the catalog is joined once, however many entries ask it.
    """
    asked = entries.where(F.col("sheet").isNotNull()).select("sheet", "contact", "position").distinct()
    rows = catalog.select("sheet", "positions", "source", F.explode("contacts").alias("contact")).distinct()
    met = asked.join(rows, ["sheet", "contact"]).where(F.array_contains("positions", F.col("position")))
    found = met.groupBy("sheet", "contact", "position").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.lit(True).alias("importable"))
    named = verified.groupBy(F.col(key).alias("__key")).agg(F.min(F.coalesce("maker", F.lit(""))).alias("maker"))
    out = entries.join(found, ["sheet", "contact", "position"], "left").join(named, F.col(key) == F.col("__key"), "left")
    none = F.array().cast("array<string>")
    return out.select(
        *entries.columns, F.col("__key").isNotNull().alias("verified"), F.coalesce("maker", F.lit("")).alias("maker"), F.coalesce("sources", none).alias("sources"), F.coalesce("importable", F.lit(False)).alias("importable")
    )


# --- interfaces -------------------------------------------------------------------------
def interface_filter(df: DataFrame, category: str = "", vendor: str = "", shell: str = "", word: str = "") -> DataFrame:
    """Entries (family, interface, vendor, relation, shell) that meet all given wishes, with their ``category`` and ``label``; empty wishes say nothing."""
    out = df.withColumns({"category": labels.interface_category("interface"), "label": labels.vendor_label("vendor")})
    if category:
        out = out.where(F.col("category") == category)
    if vendor:
        out = out.where(F.col("label") == vendor)
    if shell:
        out = out.where(F.col("shell") == shell)
    if word.strip():
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("family", "interface", "vendor", "relation")]))
        out = out.where(F.contains(hay, F.lit(word.strip().lower())))
    return out


def interface_facets(df: DataFrame, order: list[str]) -> DataFrame:
    """(facet, place, value): categories in the given order, vendors by name, shells by number; one pass over the entries."""
    x = df.select(labels.interface_category("interface").alias("category"), labels.vendor_label("vendor").alias("vendor"), "shell")
    one = x.agg(*[F.collect_set(c).alias(c) for c in ("category", "vendor", "shell")])
    by_number = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda s: F.struct(s.cast("double").alias("n"), s.alias("s")))), lambda p: p["s"])
    named = {"category": F.filter(F.array(*[F.lit(c) for c in order]), lambda c: F.array_contains("category", c)), "vendor": F.array_sort("vendor"), "shell": by_number("shell")}
    parts = [one.select(F.lit(n).alias("facet"), F.posexplode(v).alias("place", "value")) for n, v in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- texts ------------------------------------------------------------------------------
def environment_sentence(note: str, scores: str, tags: str) -> Column:
    """A part's service in a sentence: its note's first, else its scores of 4 and more, else three of its tags; empty without any.

    ``scores`` is an array of (name, score), ``tags`` one of texts; tags alike but for form are told once.
    """
    first = F.coalesce(text.first_sentence(note), F.lit(""))
    strong = F.transform(F.filter(F.coalesce(scores, F.array().cast("array<struct<name:string,score:int>>")), lambda s: s["score"] >= 4), lambda s: F.lower(text.humanize(s["name"])))
    shown = F.slice(F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: text.humanize(t))), 1, 3)
    said = lambda before, after: lambda xs: F.when(F.size(xs) > 0, F.concat(F.lit(before), text.readable_list(xs), F.lit(after)))
    of_scores = text.once(strong, said("The loaded data points to ", " service."))
    of_tags = text.once(shown, said("Environment tags include ", "."))
    return text.once(first, lambda x: F.when(x != "", x).otherwise(F.coalesce(of_scores, of_tags, F.lit(""))))


def human_summary(style: str, shell: str, arrangement: str, contact: Column, description: str, evidence: Column, service: Column, most: int = 420) -> Column:
    """A part in a few sentences: what it is, its style, how it is verified, its service; sentences that repeat are told once."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    nothing = "Contact gender is not specified."
    told = F.coalesce(contact, F.lit(""))
    vague = told.rlike(r"(?i)^Contact gender is not specified\.?$")
    lead = F.concat_ws(
        ", ",
        F.when(there(style), F.col(style)).otherwise("Connector"),
        F.when(there(shell), F.concat(F.lit("shell size "), shell)).otherwise("shell size not specified"),
        F.when(there(arrangement), F.concat(F.lit("insert arrangement "), arrangement)).otherwise("insert arrangement is not specified"),
        F.when((told != "") & ~vague, told),
    )
    # each step is bound to a name, as an expression used twice would be worked out twice for each element
    keyed = lambda s: F.struct(s.alias("s"), text.display_key(s).alias("k"))
    sentences = F.filter(F.array(lead, F.col(description), evidence, service, F.when(vague, nothing)), lambda s: s.isNotNull())
    whole = F.transform(F.filter(F.transform(sentences, lambda s: text.ensure_sentence(s)), lambda s: s != ""), keyed)
    # the first of those that are alike but for form
    kept = lambda xs, ks: F.filter(xs, lambda x, i: F.array_position(ks, x["k"]) == i + 1)
    joined = lambda xs: text.once(F.transform(xs, lambda x: x["k"]), lambda ks: F.array_join(F.transform(kept(xs, ks), lambda x: x["s"]), " "))
    return text.summarize(text.once(whole, joined), most)
