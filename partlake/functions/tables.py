"""Table functions for SQL: the two that make rows in Python, the others over views."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from partlake import refdata as R
from partlake.operators.decode import _BODY, SERIES
from partlake.operators.requirements import FUNCTIONS

_PART = re.compile(_BODY)
_SHEET = re.compile(r"^D38999/(\d{2})[A-Z0-9]+$")
_BLANKS = re.compile(r"[\s-]+")
_SERIES, _SIZES = dict(SERIES), dict(R.SHELL_SIZES)


@udtf(returnType="field string, code string, meaning string")
class DecodeNumber:
    """``decode_part_number(text)``: a row a part of the number, or one row ``error``; nothing for null."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is None:
            return
        pn = _BLANKS.sub("", text.upper())
        sheet, m = _SHEET.match(pn), _PART.match(pn)
        if not sheet or sheet[1] not in _SERIES or not m:
            yield "error", None, "not a pin" if not sheet else "unsupported sheet" if sheet[1] not in _SERIES else "class not parsed"
            return
        names = ["sheet", "class", "size", "insert", "contact", "key"]
        values = dict(zip(names, m.groups())) | {"key": m[6] or "N"}
        yield "series", _SERIES[values["sheet"]], None
        for n in names:
            yield n, values[n], _SIZES.get(values[n]) if n == "size" else None


@udtf(returnType="signal string, size string")
class PinTable:
    """``pin_table(function, count)``: the contacts of so many instances of a function; unknown ones are discrete."""

    def eval(self, function: str, count: int) -> Iterator[tuple]:
        size, per, signals = FUNCTIONS.get(function, ("22D", 1, []))
        for i in range(1, (count or 0) + 1):
            suffix = f" #{i}" if (count or 0) > 1 else ""
            for s in signals or ([(function or "").upper()] if function in FUNCTIONS else []):
                yield s + suffix, size
            if function not in FUNCTIONS:
                yield f"{function or ''} #{i}", size


#: Functions over views: name, view, parameters, columns, query.
OVER_VIEWS = {
    "search_arrangements": (
        "arrangements",
        "least BIGINT, most BIGINT",
        "id BIGINT, n_signal BIGINT, amps DOUBLE",
        "SELECT id, n_signal, amps FROM arrangements WHERE n_signal >= coalesce(least, 0) AND n_signal <= coalesce(most, n_signal)",
    ),
    "lookup_definition": (
        "definitions",
        "wanted STRING, letter STRING",
        "code STRING, meaning STRING",
        "SELECT code, meaning FROM definitions WHERE category = lower(wanted) AND upper(code) = upper(letter)",
    ),
    "list_manufacturers": ("catalog", "", "vendor STRING, n_rows BIGINT", "SELECT vendor, count(*) FROM catalog GROUP BY vendor"),
    "search_documents": (
        "texts",
        "wanted STRING",
        "id BIGINT, n_found INT",
        "SELECT id, cast((length(text) - length(replace(lower(text), lower(wanted), ''))) DIV nullif(length(wanted), 0) AS INT) FROM texts WHERE contains(lower(text), lower(wanted))",
    ),
}


def register(spark: SparkSession, views: dict[str, DataFrame]) -> list[str]:
    """Make the functions callable from SQL, laterally, too; a function over a view that is not given is left out. Their names."""
    spark.udtf.register("decode_part_number", DecodeNumber)
    spark.udtf.register("pin_table", PinTable)
    names = ["decode_part_number", "pin_table"]
    for name, (view, parameters, columns, body) in OVER_VIEWS.items():
        if view in views:
            views[view].createOrReplaceTempView(view)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
            names.append(name)
    return names
