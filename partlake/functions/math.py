"""Small numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dms_to_degrees(degrees: Column, minutes: Column) -> Column:
    return F.round(degrees + minutes / 60, 4)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def polar(cx: Column, cy: Column, r: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return cx + r * F.cos(a), cy + r * F.sin(a)


def visual_radius(r: Column, n: Column) -> Column:
    """Drawn radius of a contact: smaller in crowded arrangements, within fixed limits."""
    scale = F.when(n <= 20, 1.0).when(n <= 60, 0.85).otherwise(0.7)
    return clamp(r * scale, 1.5, 12.0)


def spare_target(total: Column, percent: Column) -> Column:
    """Two contacts at least, else the share rounded down."""
    return F.greatest(F.lit(2).cast("long"), F.floor(total * percent / 100))


def mirror_x(x: Column, centre: Column) -> Column:
    return 2 * centre - x


def fit_axis(x: Column, lo: Column, hi: Column, to_lo: Column, to_hi: Column) -> Column:
    """Linear map of one range onto another; the middle of the target where the source has no width."""
    return F.when(hi == lo, (to_lo + to_hi) / 2).otherwise(to_lo + (x - lo) * (to_hi - to_lo) / (hi - lo))
