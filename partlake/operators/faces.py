"""Connector faces: labels carried over from a reference, sizes from counts, unique labels.

Points are registered, sizes are dealt to ranks by ranges, and labels are made unique by
counting free names, each with joins on groups; only the cheapest assignment of one face's
points runs in pandas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.operators import drawing, geometry, ranges
from partlake.operators.ranking import numbered
from partlake.operators.suggestion import SIZE_ORDER
from partlake.scratch import Scratch

#: Points of a face that one task assigns; the costs of so many take 32 MB.
MOST_POINTS = 2000
#: Ranks of a cell in the join of ranks with spans.
CELL = 64


# --- labels from a reference ------------------------------------------------------------
def fit_axes(points: DataFrame, reference: DataFrame, group: str) -> DataFrame:
    """(group, sx, sy, ox, oy): x = ox + sx * x', y = oy - sy * y' bring a face's reference onto its points.

    Scales follow from the extremes of both, the vertical axis points the other way, the middles
    meet. Faces whose numbers of points differ, or whose reference has no width or height, have
    no fit. Faces over ``MOST_POINTS`` points are an error.
    """

    def extremes(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(group).agg(F.count("*").alias(f"n{p}"), *[f(c).alias(f"{c}{k}{p}") for c in "xy" for f, k in ((F.min, 0), (F.max, 1))])

    both = extremes(points, "a").join(extremes(reference, "b"), group).where("na = nb AND x1b > x0b AND y1b > y0b")
    many = F.raise_error(F.concat(F.lit("points of a face: "), F.col("na").cast("string")))
    both = both.where(F.when(F.col("na") > MOST_POINTS, many.cast("boolean")).otherwise(F.lit(True)))
    scale = lambda c: (F.col(f"{c}1a") - F.col(f"{c}0a")) / (F.col(f"{c}1b") - F.col(f"{c}0b"))
    middle = lambda c, p: (F.col(f"{c}0{p}") + F.col(f"{c}1{p}")) / 2
    both = both.select("*", scale("x").alias("sx"), scale("y").alias("sy"))
    return both.select(group, "sx", "sy", (middle("x", "a") - F.col("sx") * middle("x", "b")).alias("ox"), (middle("y", "a") + F.col("sy") * middle("y", "b")).alias("oy"))


def carry_labels(points: DataFrame, reference: DataFrame, group: str, within: float | None = None) -> DataFrame:
    """(group, id, ``found``, ``label``, ``status``, ``distance``) of points that get a reference label.

    Points and reference have (group, id, x, y, label). The fitted reference is matched to the points
    at the least sum of squared distances. Status is filled where the point's label was
    ``?`` or null, corrected where it differed, else same. A match further than
    ``within`` is refused: the point keeps its label, with status far. Faces without a fit have no rows.
    """
    fit = fit_axes(points, reference, group)
    target = reference.join(fit, group).select(group, F.lit("a").alias("side"), "id", (F.col("ox") + F.col("sx") * F.col("x")).alias("x"), (F.col("oy") - F.col("sy") * F.col("y")).alias("y"))
    own = points.join(fit.select(group), group, "left_semi").select(group, F.lit("b").alias("side"), "id", "x", "y")
    pairs = geometry.assign_points(target.union(own), group, squared=True)
    named = pairs.join(reference.select(group, "id", F.col("label").alias("new")), [group, "id"]).select(group, F.col("other").alias("id"), "new", "distance")
    named = named.join(points.select(group, "id", F.col("label").alias("found")), [group, "id"])
    far = F.col("distance") > within if within is not None else F.lit(False)
    blank = F.col("found").isNull() | (F.col("found") == "?")
    status = F.when(far, "far").when(blank, "filled").when(F.col("found") != F.col("new"), "corrected").otherwise("same")
    return named.select(group, "id", "found", F.when(far, F.col("found")).otherwise(F.col("new")).alias("label"), status.alias("status"), "distance")


def label_summary(carried: DataFrame, group: str) -> DataFrame:
    """(group, filled, corrected, far, max_distance), one row a face."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return carried.groupBy(group).agg(n("filled"), n("corrected"), n("far"), F.max("distance").alias("max_distance"))


# --- sizes from counts ------------------------------------------------------------------
def _spans(counts: Column, sizes: Column) -> Column:
    """Arrays of counts and sizes as (first, last, size), laid end to end from 1."""
    upto = lambda i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(sizes, lambda s, i: F.struct((upto(i) + 1).alias("first"), upto(i + 1).alias("last"), s.alias("size")))


def size_spans(points: DataFrame, notes: DataFrame, group: str) -> DataFrame:
    """(group, ``how``, first, last, size): which ranks by ascending diameter have which size; bins have means of six decimals.

    Points have (group, id, diameter), notes (group, pos, size, count) from a face's title. One
    note names all points (single). Else diameters are put into as many bins as there
    are notes: bins whose numbers are those of the notes by ascending size take them in
    order (bins), bins with the same numbers in another order take the first note left
    with theirs (counts). Else, if the notes add up to all points, the largest diameters
    take the largest sizes (ranked). Else there are no spans: how is ambiguous, or none without notes.
    """
    order = F.array(*[F.lit(s) for s in SIZE_ORDER])
    at = F.coalesce(F.nullif(F.array_position(order, F.col("size")), F.lit(0)), F.lit(99))
    n = points.groupBy(group).agg(F.count("*").alias("n"))
    asked = notes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "pos", F.col("count").cast("long").alias("count"), "size"))).alias("asked"))
    bins = geometry.diameter_bins(points, group, "diameter").select(group, F.round("mean", 6).alias("bin"), "n")
    bins = bins.join(asked.where(F.size("asked") > 1).select(group, F.size("asked").alias("to")), group)
    merged = drawing.merge_bins(bins, group, "to")
    seen = merged.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("mean", "n"))).alias("seen"))
    # written, as the optimizer would write the arrays out again in each use
    d = Scratch(points.sparkSession, "sizes").write(n.join(asked, group, "left").join(seen, group, "left"), "faces", keep=True)
    want, have = F.transform("asked", lambda a: a["count"]), F.transform("seen", lambda s: s["n"])
    d = d.withColumns({"want": want, "have": have, "sizes": F.transform("asked", lambda a: a["size"])})
    total = F.aggregate("want", F.lit(0).cast("long"), lambda a, x: a + x)
    how = (
        F.when(F.col("asked").isNull(), "none")
        .when(F.size("asked") == 1, "single")
        .when(F.col("want") == F.col("have"), "bins")
        .when(F.array_sort("want") == F.array_sort("have"), "counts")
        .when(total == F.col("n"), "ranked")
        .otherwise("ambiguous")
    )
    d = d.withColumn("how", how)
    # the bin's note: of those with its number, the one after as many as bins before it have taken
    taken = lambda x, i: F.size(F.filter(F.slice("have", F.lit(1), i), lambda y: y == x))
    by_count = F.transform("have", lambda x, i: F.get(F.filter("asked", lambda a: a["count"] == x), taken(x, i))["size"])
    # larger sizes first, notes of one size in their order; read from the smallest rank up
    down = F.reverse(F.array_sort(F.transform("asked", lambda a: F.struct((-a["at"]).alias("at"), a["pos"].alias("pos"), a["count"].alias("count"), a["size"].alias("size")))))
    spans = (
        F.when(F.col("how") == "single", F.array(F.struct(F.lit(1).cast("long").alias("first"), F.col("n").alias("last"), F.get("sizes", F.lit(0)).alias("size"))))
        .when(F.col("how") == "bins", _spans(F.col("want"), F.col("sizes")))
        .when(F.col("how") == "counts", _spans(F.col("have"), by_count))
        .when(F.col("how") == "ranked", _spans(F.transform(down, lambda a: a["count"]), F.transform(down, lambda a: a["size"])))
    )
    return d.select(group, "how", F.explode_outer(spans).alias("s")).select(group, "how", "s.first", "s.last", "s.size")


def assign_sizes(points: DataFrame, notes: DataFrame, group: str) -> DataFrame:
    """(group, id, ``size``, ``how``): every point with its size, null where the notes do not tell; see ``size_spans``.

    Points of one diameter are ranked by id, the larger id first.
    """
    spans = size_spans(points, notes, group)
    ranked = numbered(points.select(group, "id", "diameter"), [group], [F.asc("diameter"), F.desc("id")], "rank")
    known = ranges.in_spans(ranked, spans.where("first IS NOT NULL"), group, "rank", "first", "last", CELL).select(group, "id", "size", "how")
    rest = spans.where("first IS NULL").select(F.col(group).alias("__g"), "how")
    unknown = ranked.join(rest, F.col(group).eqNullSafe(F.col("__g"))).select(group, "id", F.lit(None).cast("string").alias("size"), "how")
    return known.unionByName(unknown)


# --- unique labels ----------------------------------------------------------------------
def unique_labels(df: DataFrame, group: str, label: str, order: list) -> DataFrame:
    """Add ``unique`` and ``status``: repeated single capitals become the first free name of that letter repeated.

    The second ``A`` of a group becomes ``AA``, the third ``AAA``, but names that stand in
    the group already are passed over, and so are names given before. Only names of one letter can
    collide, and the name of the k-th occurrence is the (k - 1)-th length of two or more at which no
    label stands: so a row needs its number among equal labels and the lengths taken, not the rows
    before it. Other repeated labels stay and are ambiguous; ``?`` and null stay without a status.
    """
    rows = numbered(df, [group, label], order, "__k")
    one = F.col(label).rlike(r"^\p{Lu}$")
    taken = df.where(F.col(label).rlike(r"^(\p{Lu})\1+$")).select(F.col(group).alias("__g"), F.substring(label, 1, 1).alias("__letter"), F.char_length(label).alias("n"))
    taken = taken.groupBy("__g", "__letter").agg(F.array_sort(F.collect_set("n")).alias("__taken"))
    met = rows.join(taken, rows[group].eqNullSafe(taken["__g"]) & (rows[label] == taken["__letter"]), "left")
    t = F.col("__k") - 1
    # before the i-th length taken (from 0) there are length - 2 - i free ones
    passed = F.size(F.filter(F.transform(F.coalesce("__taken", F.array().cast("array<int>")), lambda e, i: e - 2 - i), lambda free: free < t))
    again = (F.col("__k") > 1) & (F.col(label) != "?")
    name = F.when(again & one, F.call_function("repeat", F.col(label), (t + 1 + passed).cast("int"))).otherwise(F.col(label))
    status = F.when(F.col(label).isNull() | (F.col(label) == "?"), None).when(again & one, "renamed").when(again, "ambiguous").otherwise("first")
    return met.select(*df.columns, name.alias("unique"), status.alias("status"))
