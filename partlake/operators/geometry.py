"""Point matching inside drawings: small groups, each solved by one pandas call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def min_cost_assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in a cheapest one-to-one assignment (rows at most columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        least, prev, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[col] = True
            row = match[col]
            free = np.flatnonzero(~used[1:]) + 1
            step = cost[row - 1, free - 1] - u[row] - v[free]
            closer = step < least[free]
            least[free[closer]] = step[closer]
            prev[free[closer]] = col
            nxt = free[np.argmin(least[free])]
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col] = match[prev[col]]
            col = prev[col]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def assign_points(df: DataFrame, group: str, squared: bool = False) -> DataFrame:
    """(group, id, other, distance): ``a`` points matched to ``b`` points at least total distance (or sum of squares), group by group.

    Rows: group, side ('a' or 'b'), id, x, y. Drawings have some hundred points at most.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == s].sort_values("id") for s in "ab")
        swap = len(a) > len(b)
        p, q = (b, a) if swap else (a, b)
        if not len(p):
            return pd.DataFrame({group: [], "id": [], "other": [], "distance": []})
        cost = np.hypot(p.x.to_numpy()[:, None] - q.x.to_numpy(), p.y.to_numpy()[:, None] - q.y.to_numpy())
        to = min_cost_assignment(cost**2 if squared else cost)
        rows = [(p.id.iloc[i], q.id.iloc[j], cost[i, j]) for i, j in enumerate(to)]
        rows = [(y, x, d) if swap else (x, y, d) for x, y, d in rows]
        out = pd.DataFrame(rows, columns=["id", "other", "distance"])
        out.insert(0, group, pdf[group].iloc[0])
        return out

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(solve, f"{group} {kind}, id long, other long, distance double")


def greedy_nearest(df: DataFrame, group: str, within: float) -> DataFrame:
    """(group, id, other, distance): pairs taken nearest first, ties by ids, each point once."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == s] for s in "ab")
        pairs = a.merge(b, how="cross", suffixes=("", "_b"))  # one drawing's points
        pairs["distance"] = np.hypot(pairs.x - pairs.x_b, pairs.y - pairs.y_b)
        pairs = pairs[pairs.distance <= within].sort_values(["distance", "id", "id_b"])
        seen_a, seen_b, rows = set(), set(), []
        for i, j, d in zip(pairs.id, pairs.id_b, pairs.distance):
            if i not in seen_a and j not in seen_b:
                seen_a.add(i)
                seen_b.add(j)
                rows.append((pdf[group].iloc[0], i, j, d))
        return pd.DataFrame(rows, columns=[group, "id", "other", "distance"])

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(solve, f"{group} {kind}, id long, other long, distance double")


def diameter_bins(df: DataFrame, group: str, diameter: str) -> DataFrame:
    """(group, bin, n, mean): number and mean of the diameters that round to the same hundredth."""
    d = F.col(diameter).cast("double")
    return df.groupBy(group, F.round(d, 2).alias("bin")).agg(F.count("*").alias("n"), F.avg(d).alias("mean"))


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(F.col(x1) - F.col(x2), F.col(y1) - F.col(y2))
