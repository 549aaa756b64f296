"""Compare a query with its SQL in DuckDB, rows as multisets."""

import glob
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _norm(x):
    if isinstance(x, float):
        return f"{x:.6f}"
    if x is not None and not isinstance(x, str) and hasattr(x, "__iter__"):
        return str(list(x))
    return str(x)


def compare(spark, f, sql: str, sf: str = SF) -> None:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = f(spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    got = Counter(tuple(map(_norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = Counter(tuple(map(_norm, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want
