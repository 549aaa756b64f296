"""Current ratings, derating and contact sizing. Factors are integers in hundredths, so results are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R


#: Knots with their factors in hundredths.
KNOTS = [(n, round(f * 100)) for n, f in R.DERATING]


def derating(n: Column) -> Column:
    """Share of the single-contact rating, linear between the knots; 1 up to one contact, the last factor beyond them."""
    out = F.lit(R.DERATING[-1][1])
    for (a, fa), (b, fb) in reversed(list(zip(KNOTS, KNOTS[1:]))):
        line = (F.lit(fa * (b - a)) - (n - a) * (fa - fb)) / F.lit(100 * (b - a))
        out = F.when(n <= b, line).otherwise(out)
    return F.when(n <= 1, F.lit(1.0)).otherwise(out)


def rating(size: Column) -> Column:
    """Amps of one contact; null for unrated sizes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for s, a, *_ in R.RATINGS for x in (s, a)]), size)


def capacity(notes: DataFrame, key: str) -> DataFrame:
    """(key, ``n_signal``, ``raw_amps``, ``factor``, ``amps``) of arrangements given as rows (key, size, count)."""
    rated = notes.withColumn("rated", F.coalesce(rating(F.col("size")), rating(F.concat("size", F.lit("D"))), F.lit(0.0)))
    signal = rated.where(~F.col("size").rlike("ax$"))
    total = signal.groupBy(key).agg(F.sum("count").alias("n_signal"), F.sum(F.col("rated") * F.col("count")).alias("raw_amps"))
    return total.withColumn("factor", derating(F.col("n_signal"))).withColumn("amps", F.round(F.col("raw_amps") * F.col("factor"), 1))


def smallest_size(amps: Column) -> Column:
    """The smallest contact whose rating reaches the need; null beyond the largest."""
    out = F.lit(None).cast("string")
    for s, a, *_ in sorted(R.RATINGS, key=lambda r: -r[1]):
        out = F.when(amps <= a, F.lit(s)).otherwise(out)
    return out


#: Sizes tried for power, smallest first, and the most contacts of one size.
POWER_SIZES, MOST = ["22D", "20", "16", "12"], 49


def _enough(rated: Column | float, amps: Column, other: Column):
    def test(n: Column) -> Column:
        each = (F.lit(rated) if isinstance(rated, float) else rated) * derating(other + n)
        spare = (amps <= 13) | ((n >= 2) & ((n - 1) * each >= amps))
        return (n * each * 100 >= amps * 125) & spare

    return test


def power_contacts(amps: Column, other: Column) -> Column:
    """Struct (size, n): contacts that carry a load beside ``other`` contacts.

    For each size the fewest n with n * rating * derating(other + n) at 1.25 times the load
    or more, and two at least with one to spare above 13 A. From the smallest size that can,
    a larger one replaces it only when it saves two contacts. Null when none can; no contact
    for no load. Sizes are an array that is folded, so the search is written out once.
    """
    amps_of = {s: a for s, a, *_ in R.RATINGS}
    sizes = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(amps_of[s]).alias("rated")) for s in POWER_SIZES])

    def fewest(s: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(1), F.lit(MOST)), _enough(s["rated"], amps, other))
        return F.struct(s["size"].alias("size"), F.get(fits, F.lit(0)).alias("n"))

    found = F.filter(F.transform(sizes, fewest), lambda c: c["n"].isNotNull())
    none = F.lit(None).cast("struct<size:string,n:int>")
    best = F.aggregate(found, none, lambda acc, c: F.when(acc.isNull() | (c["n"] <= acc["n"] - 2), c).otherwise(acc))
    return F.when(amps <= 0, F.struct(F.lit("none").alias("size"), F.lit(0).alias("n"))).otherwise(best)
