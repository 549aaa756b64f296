"""Labels, ratings and roles read out of short catalog texts, as column expressions.

Null texts count as empty. Ladders are ``CASE`` chains in which the first hit decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions.text import _c, squeeze, strip_tags


def _low(c) -> Column:
    return F.lower(F.coalesce(_c(c), F.lit("")))


def ladder(text: Column, steps: list[tuple[str, str]], otherwise: str | None = "") -> Column:
    """The value of the first pattern that is found in the text."""
    out = F.lit(otherwise)
    for pattern, value in reversed(steps):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


# --- cells of qualification lists --------------------------------------------------------
def vendor_token(c) -> Column:
    """The part number at the front of a vendor cell."""
    return F.regexp_extract(strip_tags(_c(c)), r"^(\S*)", 1)


def vendor_note(c) -> Column:
    """What follows it without outer brackets and hyphens; empty where no letter or digit is left."""
    rest = F.regexp_replace(F.regexp_replace(strip_tags(_c(c)), r"^\S*\s*", ""), r"^[()\- ]+|[()\- ]+$", "")
    return F.when(rest.rlike("[A-Za-z0-9]"), rest).otherwise("")


def status_of_alt(c) -> Column:
    """certified or inactive by an icon's text; other texts as they are, trimmed."""
    t = _low(c)
    inactive = t.contains("inactive") | t.contains("no longer") | t.contains("not ")
    return F.when(t.contains("certified") & ~t.contains("not"), "certified").when(inactive, "inactive").otherwise(F.trim(F.coalesce(_c(c), F.lit(""))))


# --- sizes, ids and numbers --------------------------------------------------------------
def clean_size(c) -> Column:
    """A contact size without ``#``, single blanks, Coax and Twinax with a capital."""
    x = squeeze(F.replace(_c(c), F.lit("#"), F.lit("")))
    return F.replace(F.replace(x, F.lit("coax"), F.lit("Coax")), F.lit("twinax"), F.lit("Twinax"))


def citation(pdf, page, section) -> Column:
    """``file p. N, section`` with the parts that there are."""
    page_text = F.concat(F.lit("p. "), _c(page).cast("string"))
    first = F.concat_ws(" ", F.nullif(_c(pdf), F.lit("")), page_text)
    return F.concat(first, F.coalesce(F.concat(F.lit(", "), F.nullif(_c(section), F.lit(""))), F.lit("")))


def arrangement_id(c) -> Column:
    """``shell-number`` with the number's leading zeros gone; a number of zeros only is 0."""
    parts = F.split(_c(c), "-")
    number = F.regexp_replace(F.get(parts, F.lit(1)), "^0+", "")
    return F.when(F.size(parts) < 2, _c(c)).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("-"), F.when(number == "", "0").otherwise(number)))


def color_hex(c) -> Column:
    """An array of three channels from 0 to 1 as ``#rrggbb``; null for fewer channels."""
    one = lambda x: F.lpad(F.lower(F.hex(F.least(F.greatest(F.bround(x * 255, 0).cast("long"), F.lit(0)), F.lit(255)))), 2, "0")
    return F.when(F.size(_c(c)) >= 3, F.concat(F.lit("#"), F.array_join(F.transform(F.slice(_c(c), 1, 3), one), "")))


def is_black(c) -> Column:
    """All channels below a fifth; no color is not black."""
    return F.coalesce(F.forall(_c(c), lambda x: x < 0.2), F.lit(False))


def leading_decimal(c) -> Column:
    """The signed decimal that a line starts with; a number without a point does not count."""
    return F.nullif(F.regexp_extract(F.trim(_c(c)), r"^[+-]?\d*\.\d+", 0), F.lit("")).try_cast("double")


def service_rating(c) -> Column:
    """Text between an arrangement id and the first count of contacts; else the first word after the id; else unknown."""
    rest = F.trim(F.regexp_extract(_c(c), r"^.*?\d{1,2}-\d{1,3}(.*)$", 1))
    head = F.trim(F.regexp_extract(rest, r"^(.*?)\d+\s*x?\s*#", 1))
    word = F.regexp_extract(rest, r"^(\S+)", 1)
    counted = rest.rlike(r"\d+\s*x?\s*#")
    return F.when(counted, F.when(head == "", "unknown").otherwise(head)).when(word == "", "unknown").otherwise(word)


def sheets_of_style(c) -> Column:
    """The slash sheets in a style code such as ``/20 WB /24``: parts of two digits or more."""
    return F.filter(F.transform(F.split(_c(c), r"[\s/]+"), lambda p: F.regexp_extract(p, r"^(\d{2,})$", 1)), lambda p: p != "")


def base_number(c) -> Column:
    """The ``ddd-ddd`` at the front of a vendor number; empty without one."""
    return F.regexp_extract(_c(c), r"^(\d{3}-\d{3})", 1)


def dated(c) -> Column:
    """What a text states after ``Dated:``, as it stands."""
    return F.trim(F.regexp_extract(_c(c), r"Dated:\s*([^\n]*)", 1))


# --- roles and genders -------------------------------------------------------------------
# --- fixed values: words that decide, in order
MALE = r"\b(plug|cordset|cable[- ]?side|male)\b"
FEMALE = r"\b(receptacle|jack|female|jam[- ]?nut|feed[- ]?thru|feedthru|bulkhead|panel[- ]?mount|wall[- ]?mount)\b"
ROLES = [(r"^plug$|\bplug\b|drive[- ]?thru|cordset|memory stick|cable", "plug"), (r"receptacle|jam[- ]?nut|wall|flange|stand[- ]?off|feed[- ]?thru|bulkhead", "receptacle")]
MOUNTING = [
    ("jam[- ]?nut", "jam-nut"), ("wall[- ]?mount", "wall mount"), ("square[- ]?flange", "square flange"), ("panel", "panel mount"),
    ("in[- ]?line", "in-line"), ("cap|dummy|protective", "accessory"), ("straight|cable", "cable"),
]
CATEGORIES = [("rj45|ethernet", "RJ45 / Ethernet"), ("type-c|usb-c", "USB-C"), ("usb", "USB"), ("hdmi", "HDMI"), ("displayport", "DisplayPort")]
VENDORS = [("glenair", "Glenair"), ("cinch", "Cinch"), ("amphenol", "Amphenol"), ("te |deutsch|connectivity", "TE / Deutsch")]
GAUGES = [("22d", "22d"), ("20", "20"), ("16", "16"), ("12", "12"), ("10", "10"), ("8", "8")]
SHIELDED = [("quadrax", "quadrax"), ("twinax", "twinax"), ("coax", "coax")]
BORES = {"coax": 1, "twinax": 2, "quadrax": 4}
STATUS_LABELS = [("exact match|verified|secondary exact", "exact"), ("valid format", "format valid"), ("invalid", "unsupported"), ("vendor specific", "needs review")]
MATERIALS = [("aluminum nickel bronze",) * 2, ("composite",) * 2, ("stainless steel",) * 2, ("corrosion resistant steel",) * 2, ("aluminum",) * 2]
CLASS_MATERIALS = [("L", "stainless steel"), ("N", "stainless steel"), ("S", "stainless steel"), ("R", "corrosion resistant steel"), ("B", "marine bronze")]


def gender(c) -> Column:
    """male or female by the words of a text, male ones first; null for none."""
    t = _low(c)
    return F.when(t.rlike(MALE), "male").when(t.rlike(FEMALE), "female")


def gender_key(c) -> Column:
    """The genders that a text names, joined by ``+``; ``female`` names both, as it holds ``male``."""
    t = _low(c)
    return F.concat_ws("+", F.when(t.contains("female"), "female"), F.when(t.contains("male"), "male"))


def gender_summary(c, fallback) -> Column:
    """The variants in an ordering rule: plug, kinds of receptacle, feedthrough, bulkhead."""
    t = _low(c)
    kinds = ["square-flange", "jam-nut", "wall-mount"]
    has = [F.when(t.rlike(k.replace("-", "[- ]?")) & ~t.rlike("no " + k.replace("-", "[- ]?")), k) for k in kinds]
    named = F.filter(F.array(*has), lambda x: x.isNotNull())
    receptacle = (
        F.when(F.size(named) > 1, F.concat(F.array_join(named, " / "), F.lit(" receptacles")))
        .when(F.size(named) == 1, F.concat(F.array_join(named, " / "), F.lit(" receptacle")))
        .when(t.rlike("receptacle|jack"), "panel receptacle")
    )
    plug = F.when(t.rlike(r"\bplug\b|free connector|cable[- ]?side|cable plug|cordset"), "plug")
    out = F.concat_ws(", ", plug, receptacle, F.when(t.rlike("feed[- ]?thr(u|ough)"), "feedthrough"), F.when(t.contains("bulkhead"), "bulkhead"))
    return F.when(out == "", F.coalesce(_c(fallback), F.lit(""))).otherwise(out)


def mounting_role(c) -> Column:
    return ladder(_low(c), ROLES)


def mounting_style(c, role) -> Column:
    """How a connector is mounted by its label and summary; a plug without a word for it hangs on a cable."""
    by_text = ladder(_low(c), MOUNTING)
    return F.when((by_text == "") & (_c(role) == "plug"), "cable").otherwise(by_text)


def interface_category(c) -> Column:
    return ladder(_low(c), CATEGORIES, "Other")


def vendor_label(c) -> Column:
    known = ladder(_low(c), VENDORS, None)
    return F.coalesce(known, F.nullif(F.trim(F.coalesce(_c(c), F.lit(""))), F.lit("")), F.lit("Other"))


def gauge(c) -> Column:
    return ladder(_low(c), GAUGES, "unknown")


def shield(kind, size) -> Column:
    """coax, twinax or quadrax by a contact's type or size; empty for a plain one."""
    return ladder(F.concat_ws(" ", _low(kind), _low(size)), SHIELDED)


def bores(kind, size) -> Column:
    out = F.lit(0)
    for k, n in BORES.items():
        out = F.when(shield(kind, size) == k, n).otherwise(out)
    return out


def service_bucket(c) -> Column:
    """A rating's group: a named kind, else N, M, II or I by its letters alone (l is read as i)."""
    t = _low(c)
    core = F.regexp_replace(t, "[^a-z]", "")
    named = ladder(t, [("fiber", "fiber"), ("coax", "coax"), ("twinax", "twinax"), ("inst", "inst")], None)
    letters = ladder(core, [("^n$", "n"), ("^m$", "m"), ("^(ii|il|ll)$", "ii"), ("^[il]$", "i")], "unknown")
    return F.coalesce(named, letters)


def label_provenance(c) -> Column:
    x = _c(c)
    return F.when(x == "standard_reference", "MIL-STD-1560").when(x == "high", "catalog PDF").otherwise(F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown")))


def status_label(c) -> Column:
    return ladder(_low(c), STATUS_LABELS, "missing data")


def is_exact_status(c) -> Column:
    return F.coalesce(_c(c).isin("exact match", "verified", "secondary exact"), F.lit(False))


def contact_gender(contact) -> Column:
    """pin or socket by the contact's definition, which starts with one of them or ends with it; else empty."""
    meaning = F.lower(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in R.CONTACTS for x in p]), _c(contact)), F.lit("")))
    return ladder(meaning, [(r"\bpin\b", "pin"), (r"\bsocket\b", "socket")])


def contact_summary(contact) -> Column:
    """How a contact is put in words: its gender, else its definition, else that nothing is known."""
    meaning = F.try_element_at(F.create_map(*[F.lit(x) for p in R.CONTACTS for x in p]), _c(contact))
    g = contact_gender(contact)
    return (
        F.when(g != "", F.concat(F.lit("using "), g, F.lit(" contacts")))
        .when(meaning.isNotNull(), F.concat(F.lit("contact style: "), meaning))
        .otherwise("Contact gender is not specified.")
    )


def face_is_mirrored(gender_col, view) -> Column:
    """A socket face is drawn mirrored from the front, a pin face from the rear."""
    return ((_c(gender_col) == "socket") & (_c(view) == "front")) | ((_c(gender_col) == "pin") & (_c(view) == "rear"))


# --- environment texts -------------------------------------------------------------------
def coupling(stated, description, series) -> Column:
    """A document's coupling, else the first kind that its text names, else the series' own."""
    named = ladder(_low(description), [("threaded", "threaded"), ("breech", "breech"), ("bayonet", "bayonet")], None)
    own = F.when(_c(series) == "III", "threaded").when(_c(series) == "IV", "breech").otherwise("unknown")
    return F.coalesce(F.nullif(_c(stated), F.lit("")), named, own)


def shell_material(description, cls) -> Column:
    """A class's fixed material where it has one, else the first that the text names."""
    fixed = F.try_element_at(F.create_map(*[F.lit(x) for p in CLASS_MATERIALS for x in p]), _c(cls))
    return F.coalesce(fixed, ladder(_low(description), MATERIALS, "unknown"))


def shell_size(code) -> Column:
    """Digits as they are; else the size of the code, or of its first letter; else unknown."""
    sizes = F.create_map(*[F.lit(x) for p in R.SHELL_SIZES for x in p])
    x = F.coalesce(_c(code), F.lit(""))
    return F.when(x.rlike(r"^\d+$"), x).otherwise(F.coalesce(F.try_element_at(sizes, x), F.try_element_at(sizes, F.substring(x, 1, 1)), F.lit("unknown")))


def contact_kind(text, contact) -> Column:
    """pin or socket by a document's words, else by the contact letter, else unknown."""
    t = _low(text)
    by_text = F.when(t.contains(" pins") | t.endswith("pins"), "pin").when(t.contains(" sockets") | t.endswith("sockets"), "socket")
    return F.coalesce(by_text, F.nullif(contact_gender(contact), F.lit("")), F.lit("unknown"))


def shell_style(mount, component) -> Column:
    m, c = F.trim(F.coalesce(_c(mount), F.lit(""))), F.trim(F.coalesce(_c(component), F.lit("")))
    both = (m != "") & (c != "") & ~m.contains(c)
    return F.when(both, F.concat(m, F.lit(" "), c)).otherwise(F.coalesce(F.nullif(m, F.lit("")), F.nullif(c, F.lit("")), F.lit("unknown")))


def vendor_name(names) -> Column:
    """The only vendor, ``multiple``, or ``unknown``."""
    n = F.size(F.coalesce(_c(names), F.array().cast("array<string>")))
    return F.when(n == 1, F.get(_c(names), F.lit(0))).when(n > 1, "multiple").otherwise("unknown")
