"""String functions as column expressions; every one stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(c, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it: inside lambdas an expression used twice is run twice."""
    return F.get(F.transform(F.array(_c(c)), lambda x: f(x)), F.lit(0))


def compact(c) -> Column:
    """Upper case without white space and hyphens."""
    return F.regexp_replace(F.upper(_c(c)), r"[\s-]+", "")


def normal_key(c) -> Column:
    """Upper case with only A-Z, 0-9 and slash; null is empty."""
    return F.regexp_replace(F.upper(F.coalesce(_c(c), F.lit(""))), "[^A-Z0-9/]", "")


def canonical(c) -> Column:
    """Upper case without white space; hyphens stay."""
    return F.regexp_replace(F.upper(_c(c)), r"\s+", "")


def strip_dashes(c) -> Column:
    return F.replace(_c(c), F.lit("-"), F.lit(""))


def complete_shorthand(c, family_prefixes: list[str] = ()) -> Column:
    """Write out a shortened part number: a bare number, a leading slash or two leading digits get the standard's prefix."""
    x = F.regexp_replace(F.upper(F.trim(_c(c))), r"\s+", "")
    family = F.lit(False)
    for p in family_prefixes:
        family = family | x.startswith(p)
    return (
        F.when(family | x.startswith("D38999/"), x)
        .when(x.startswith("D38999"), F.concat(F.lit("D38999/"), F.substring(x, 7, 1000)))
        .when(x.startswith("/"), F.concat(F.lit("D38999"), x))
        .when(x.rlike(r"^\d{2}"), F.concat(F.lit("D38999/"), x))
        .otherwise(x)
    )


def is_incomplete(c) -> Column:
    """Fewer than two sheet digits, or fewer than five characters after them."""
    return ~F.coalesce(canonical(c).rlike(r"^D38999/\d{2}.{5,}$"), F.lit(False))


def strip_order_suffixes(c) -> Column:
    """Without a closing ``-LC``, then ``F<3 digits>`` with optional ``LF``/``LFC``, then ``-LF``."""
    x = _c(c)
    for pattern in (r"(?i)-LC$", r"(?i)F\d{3}(LFC?)?$", r"(?i)-LF$"):
        x = F.regexp_replace(x, pattern, "")
    return x


def drop_crimp_mark(c) -> Column:
    """Without the first R that only letters follow to the end."""
    return F.regexp_replace(_c(c), r"R([A-Z]+)$", "$1")


def squeeze(c) -> Column:
    """White space collapsed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def unescape(c) -> Column:
    x = _c(c)
    for a, b in ENTITIES:  # the ampersand last, so no reference is decoded twice
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def strip_tags(c, with_blank: bool = True) -> Column:
    """Markup removed, references decoded, white space collapsed."""
    return squeeze(unescape(F.regexp_replace(_c(c), "<[^>]*>", " " if with_blank else "")))


def escape_html(c) -> Column:
    x = _c(c)
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_csv(c) -> Column:
    """Quoted only where it holds a quote, comma or line end; quotes doubled; null is empty."""
    x = F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.when(x.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def natural_key(c, width: int = 12) -> Column:
    """A key whose plain order is the natural one: lower case, digit runs padded with zeros."""
    parts = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\d+|\D+)"))
    padded = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(p))
    return F.array_join(padded, "")


def display_key(c) -> Column:
    """Equal for labels that differ in case, underscores, or blanks around slash and hyphen."""
    x = F.regexp_replace(F.trim(_c(c)), r"[_\s]+", " ")
    return F.lower(F.regexp_replace(x, r"\s*([/-])\s*", "$1"))


def display_score(c) -> Column:
    """How presentable a label is, in hundredths: 100 trimmed, 300 no underscore, 200 mixed case, 200 not all capitals, 100 with / or -, its length up to 48."""
    x = _c(c)
    points = [
        (x == F.trim(x), 100),
        (~x.contains("_"), 300),
        (x.rlike("[a-z]") & x.rlike("[A-Z]"), 200),
        (x != F.upper(x), 200),
        (x.rlike("[/-]"), 100),
    ]
    total = F.least(F.length(x), F.lit(48))
    for cond, n in points:
        total = total + F.when(cond, F.lit(n)).otherwise(F.lit(0))
    return total


def humanize(c) -> Column:
    """Words of an identifier with a capital each; short known acronyms and letter-digit tokens in capitals."""
    words = F.filter(F.split(F.lower(_c(c)), "[_-]+"), lambda w: w != "")
    shown = F.transform(
        words,
        lambda w: F.when(w.isin("emi", "rfi", "uav", "pcb", "usb", "rf") | w.rlike(r"^[a-z]\d+$"), F.upper(w)).otherwise(F.initcap(w)),
    )
    return F.array_join(shown, " ")


def readable_list(items) -> Column:
    """``a``; ``a and b``; ``a, b, and c``."""
    x = _c(items)
    n = F.size(x)
    return (
        F.when(n <= 1, F.array_join(x, ""))
        .when(n == 2, F.array_join(x, " and "))
        .otherwise(F.concat(F.array_join(F.slice(x, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(x, -1)))
    )


def ensure_sentence(c) -> Column:
    x = F.trim(_c(c))
    return F.when((x == "") | x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, F.lit(".")))


def first_sentence(c) -> Column:
    cut = lambda x: once(F.regexp_extract(x, r"^(.*?[.!?])(\s|$)", 1), lambda first: F.when(first == "", x).otherwise(first))
    return once(squeeze(c), cut)


def summarize(c, limit: int) -> Column:
    """Collapsed text; beyond ``limit`` characters the first ``limit - 3``, trimmed, and three points."""
    return once(squeeze(c), lambda x: F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit - 3)), F.lit("..."))).otherwise(x))


def snake_case(c) -> Column:
    x = F.regexp_replace(_c(c), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2"))


def token(c) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")


def safe_filename(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(c), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def fill_template(template, values) -> Column:
    """``{name}`` replaced from a map column; unknown names stay."""
    t = _c(template)
    entries = F.map_entries(_c(values))
    return F.aggregate(
        entries, t, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"])
    )
