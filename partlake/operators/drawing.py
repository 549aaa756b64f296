"""Drawings of connector faces: filters, crops, ticks, keys, bins and clusters of points.

A drawing has some hundred shapes at most; bins and clusters depend on the order in which
they are taken, so these two run in Python: bins for many drawings a batch, clusters in pandas, one
drawing at a time. The rest are expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.functions.math import polar


def outline_candidates(df: DataFrame) -> DataFrame:
    """Shapes that can be the outline of a face: stroked, nearly square, 12 to 100 wide."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return df.where(F.col("stroked") & w.between(12, 100) & (F.abs(w - h) <= 0.05 * w))


def crop(df: DataFrame, group: str, page: tuple[float, float], share: float = 0.12) -> DataFrame:
    """(group, x0, y0, x1, y1): the box around all shapes, widened by a share of its outline's width (5 at least), within the page."""
    box = df.groupBy(group).agg(
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.max(F.when(F.col("outline"), F.col("x1") - F.col("x0"))).alias("w")
    )
    pad = F.greatest(F.lit(5.0), F.coalesce(F.col("w"), F.lit(0.0)) * share)
    low = lambda c: F.greatest(F.lit(0.0), F.col(c) - pad).alias(c)
    high = lambda c, most: F.least(F.lit(float(most)), F.col(c) + pad).alias(c)
    return box.select(group, low("x0"), low("y0"), high("x1", page[0]), high("y1", page[1]))


def meets(a: str, b: str) -> Column:
    """Whether two boxes (structs of x0, y0, x1, y1) share an area."""
    return (F.col(f"{a}.x0") < F.col(f"{b}.x1")) & (F.col(f"{b}.x0") < F.col(f"{a}.x1")) & (F.col(f"{a}.y0") < F.col(f"{b}.y1")) & (F.col(f"{b}.y0") < F.col(f"{a}.y1"))


def is_tick(contacts: str) -> Column:
    """Whether a line (x1, y1, x2, y2) is a contact's tick: its middle within 0.8 radii of a contact, no longer than 4 radii."""
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return F.exists(contacts, lambda c: (F.hypot(c["x"] - mx, c["y"] - my) <= 0.8 * c["r"]) & (length <= 4 * c["r"]))


def guide_lines(df: DataFrame, contacts: str) -> DataFrame:
    """Thin black strokes of 1.2 or longer that are no contact's tick."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return df.where((F.col("width") <= 1) & F.col("black") & (length >= 1.2) & ~is_tick(contacts))


def key_lines(df: DataFrame, angles: str, cx: float, cy: float, r0: float, r1: float) -> DataFrame:
    """(all columns, angle, x1, y1, x2, y2): one radial line for each keying angle, in hundredths."""
    each = df.withColumn("angle", F.explode(angles))
    a, b = polar(F.lit(cx), F.lit(cy), F.lit(r0), F.col("angle")), polar(F.lit(cx), F.lit(cy), F.lit(r1), F.col("angle"))
    return each.select(*df.columns, "angle", *[F.round(c, 2).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (*a, *b))])


def reading_order(df: DataFrame, group: str, y: str, x: str, tie: str) -> DataFrame:
    """Add ``place`` from 1 in each group: top to bottom, then left to right."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(y, x, tie)))


def merge_bins(df: DataFrame, group: str, to: int | str) -> DataFrame:
    """(group, mean, n): diameters in ``to`` bins at most (a number or a column); neighbours with the nearest means merge first, the lower on a tie.

    Rows: group, bin (mean diameter), n. A merged bin's mean weighs both by their number.
    """

    def merged(bins: list[dict], most: int) -> list[dict]:
        mean, n = [np.nan if x["bin"] is None else x["bin"] for x in bins], [x["n"] for x in bins]
        while len(mean) > most:
            i = int(np.argmin(np.diff(mean)))
            total = n[i] + n[i + 1]
            mean[i : i + 2] = [(mean[i] * n[i] + mean[i + 1] * n[i + 1]) / total]
            n[i : i + 2] = [total]
        return [{"mean": m, "n": k} for m, k in zip(mean, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("mean", pa.float64()), ("n", pa.int64())]))
        for b in batches:
            out = [merged(x, k) for x, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=[group, "bins"])

    # a face is a row with an array of its bins, and a batch holds many faces: a call for each face costs more than its work
    bins = F.array_sort(F.collect_list(F.struct(F.col("bin").isNull().alias("last"), F.col("bin").cast("double").alias("bin"), F.col("n").cast("long").alias("n"))))
    faces = df.groupBy(group).agg(bins.alias("bins"), (F.max(to) if isinstance(to, str) else F.lit(to)).cast("int").alias("to"))
    kind = df.schema[group].dataType.simpleString()
    out = faces.mapInArrow(run, f"`{group}` {kind}, bins array<struct<mean:double,n:long>>")
    return out.select(group, F.explode("bins").alias("b")).select(group, "b.mean", "b.n")


def cluster_points(df: DataFrame, group: str, share: float = 0.5) -> DataFrame:
    """(group, x, y, r, n): circles taken largest first; one joins the first cluster whose centre lies within a share of that cluster's largest radius.

    A centre is the mean of its circles weighted by radius. Rows: group, id, x, y, r; ties by id.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[float]] = []  # x, y, largest r, weight, n
        for x, y, r in pdf.sort_values(["r", "id"], ascending=[False, True])[["x", "y", "r"]].itertuples(index=False):
            for c in out:
                if np.hypot(c[0] - x, c[1] - y) <= share * c[2]:
                    w = c[3] + r
                    c[0], c[1], c[3], c[4] = (c[0] * c[3] + x * r) / w, (c[1] * c[3] + y * r) / w, w, c[4] + 1
                    break
            else:
                out.append([x, y, r, r, 1])
        rows = [(pdf[group].iloc[0], c[0], c[1], c[2], c[4]) for c in out]
        return pd.DataFrame(rows, columns=[group, "x", "y", "r", "n"])

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(cluster, f"{group} {kind}, x double, y double, r double, n long")
