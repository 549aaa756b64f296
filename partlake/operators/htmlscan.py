"""Rows out of HTML by regular expressions, without leaving generated code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partlake.functions.labels import status_of_alt, vendor_note, vendor_token
from partlake.functions.text import strip_tags, unescape


def links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pos, href, label): anchors in order; the two captures are zipped, not joined."""
    pattern = r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    both = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), 1).alias("href"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("label")
    )
    out = pages.select(id_col, F.posexplode(both).alias("pos", "a"))
    return out.select(id_col, "pos", F.col("a.href").alias("href"), strip_tags(F.col("a.label")).alias("label"))


def visible_text(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, text): scripts, styles and comments dropped, tags to blanks, references decoded."""
    x = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return pages.select(id_col, strip_tags(x).alias("text"))


def title(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(id_col, strip_tags(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)).alias("title"))


def tag_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    tags = F.regexp_extract_all(html, F.lit(r"<([a-z][a-z0-9]*)[ >]"), 1)
    return pages.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def grid_rows(df: DataFrame, html: str, fields: list[str]) -> DataFrame:
    """(row, one column a field): a grid whose cells are ``<span id="..._ctl<row>_lbl<Field>">value</span>``, pivoted; rows without any field go."""
    pattern = r'<span id="[^"]*_ctl(\d+)_lbl([A-Za-z]+)">([^<]*)</span>'
    cells = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(pattern), i).alias(n) for i, n in ((1, "row"), (2, "field"), (3, "value"))])
    flat = df.select(F.explode(cells).alias("c")).select(F.col("c.row").cast("long").alias("row"), "c.field", strip_tags(F.col("c.value")).alias("value"))
    wide = flat.groupBy("row").pivot("field", fields).agg(F.max("value"))
    return wide.where(F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields]).isNotNull())


def detail_rows(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, row, cage, company, country, part, note, status): the makers on a detail page, one row a control number.

    Cells are ``<span id="..._ctl<row>_lbl<Field>">``, a status is the text of an image
    ``..._ctl<row>_img<...> alt="..."``. Of cells that repeat a field the last one holds. Rows
    without a code, a company and a part go; missing fields are empty texts.
    """
    cell, icon = r'<span id="[^"]*_ctl(\d+)_lbl([A-Za-z]+)">(.*?)</span>', r'<img id="[^"]*_ctl(\d+)_img[A-Za-z]*"[^>]*? alt="([^"]*)"'
    text = F.coalesce(F.col(html), F.lit(""))
    found = lambda p, i: F.regexp_extract_all(text, F.lit(p), i)
    cells = F.arrays_zip(found(cell, 1).alias("row"), found(cell, 2).alias("field"), found(cell, 3).alias("value"))
    icons = F.transform(F.arrays_zip(found(icon, 1).alias("row"), found(icon, 2).alias("value")), lambda x: F.struct(x["row"].alias("row"), F.lit("Status").alias("field"), x["value"].alias("value")))
    flat = pages.select(F.col(id_col).alias("id"), F.posexplode(F.concat(cells, icons)).alias("pos", "c")).select("id", F.col("c.row").cast("long").alias("row"), "pos", "c.field", "c.value")
    last = lambda f: F.coalesce(F.max_by("value", F.when(F.col("field") == f, F.col("pos"))), F.lit(""))
    wide = flat.groupBy("id", "row").agg(*[last(f).alias(f) for f in ("CAGECode", "Company", "Country", "MfgPart", "Status")])
    plain = {"cage": strip_tags(F.col("CAGECode")), "company": strip_tags(F.col("Company")), "country": strip_tags(F.col("Country"))}
    wide = wide.withColumns(plain | {"part": vendor_token("MfgPart"), "note": vendor_note("MfgPart"), "status": status_of_alt(unescape("Status"))})
    return wide.where("cage <> '' OR company <> '' OR part <> ''").select(F.col("id").alias(id_col), "row", "cage", "company", "country", "part", "note", "status")


#: What a title says, first needle in order wins.
MOUNTS = [
    ("wall-mount", "wall"), ("box-mount", "box"), ("jam-nut", "jam nut"), ("solder-mount", "solder"), ("weld-mount", "weld"), ("in-line", "in-line"), ("straight plug", "plug"),
]


def classify_titles(df: DataFrame, col: str) -> DataFrame:
    """Add ``sheet_no``, ``series``, ``component``, ``mount`` and ``draft`` from a document title."""
    t = F.lower(F.col(col))
    mount = F.lit("unknown")
    for needle, name in reversed(MOUNTS):
        mount = F.when(t.contains(needle), name).otherwise(mount)
    series = F.when(t.rlike(r"series iv\b"), "IV").when(t.rlike(r"series iii\b"), "III").when(t.rlike(r"series ii\b"), "II").when(t.rlike(r"series i\b"), "I")
    component = F.when(t.contains("plug"), "plug").when(t.contains("receptacle"), "receptacle").otherwise("other")
    return df.withColumns(
        {
            "sheet_no": F.nullif(F.regexp_extract(col, r"/(\d+)", 1), F.lit("")),
            "series": series,
            "component": component,
            "mount": mount,
            "draft": t.contains("initial draft"),
        }
    )


def form_page(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, ``fields``, ``page``, ``pages``, ``total``, ``numbers``): what a result page's form and counter say.

    ``fields`` are name=value of inputs other than buttons and files, in order; ``page`` and
    ``pages`` from ``Page a of b``, an error where a page has none; ``total`` from
    ``n records``, null without; ``numbers`` the part numbers in the text. Lists are joined by commas.
    """
    inputs = F.regexp_extract_all(html, F.lit(r"(?i)<input\b([^>]*)>"), 1)
    attr = lambda x, name: F.regexp_extract(x, rf"(?i)\b{name}\s*=\s*[\"']?([^\"'>\s]*)", 1)
    kept = F.filter(inputs, lambda x: ~F.lower(attr(x, "type")).isin("submit", "image", "button", "reset", "file") & (attr(x, "name") != ""))
    fields = F.transform(kept, lambda x: F.concat(attr(x, "name"), F.lit("="), unescape(attr(x, "value"))))
    counter = lambda i: F.regexp_extract(html, r"Page (\d+) of (\d+)", i)
    page = F.when(counter(1) == "", F.raise_error(F.lit("no page counter"))).otherwise(counter(1)).cast("long")
    total = F.nullif(F.replace(F.regexp_extract(html, r"([\d,]+) records", 1), F.lit(","), F.lit("")), F.lit("")).cast("long")
    numbers = F.regexp_extract_all(F.regexp_replace(html, "<[^>]*>", "\n"), F.lit(r"D38999/\d{2}[A-Z0-9]+"), 0)
    return pages.select(
        id_col, F.array_join(fields, ",").alias("fields"), page.alias("page"), counter(2).cast("int").alias("pages"), total.alias("total"), F.array_join(numbers, ",").alias("numbers")
    )


def table_triples(lines: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """(group, label, x, y): a label line followed by two lines with numbers; the last one of a label wins. One window over a document's lines."""
    w = Window.partitionBy(group).orderBy(order)
    near = lines.select(group, order, F.col(line).alias("label"), F.lead(line, 1).over(w).alias("a"), F.lead(line, 2).over(w).alias("b"))
    number = r"^[+-]?\d*\.\d+$"
    fit = near.where(F.col("label").rlike("^[A-Za-z]+$") & F.col("a").rlike(number) & F.col("b").rlike(number))
    last = fit.groupBy(group, "label").agg(F.max_by(F.struct(F.col("a").cast("double").alias("x"), F.col("b").cast("double").alias("y")), order).alias("v"))
    return last.select(group, "label", "v.x", "v.y")
