"""Interfaces asked for, and the wishes that have to be given up to meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: words by which a text names an interface
WORDS = {
    "ethernet": ["ethernet", "rj45", "cat5", "cat6", "1000base", "100base", "10gbase", "gigabit"],
    "usb": ["usb", "type-c", "type_c"],
    "usb_c": ["usb-c", "usb_c", "type-c", "type_c"],
    "hdmi": ["hdmi"],
    "displayport": ["displayport", "dp"],
    "fast": ["high-speed", "high_speed", "highspeed"],
}
# --- end of fixed values
#: What a 10 gigabit or high-speed request takes as such, by interface or family.
FAST_INTERFACE, FAST_FAMILY = ["10g", "high-speed"], ["speedmaster", "machforce"]
BRANCHES = ["hdmi", "displayport", "fast_ethernet", "fast", "ethernet", "usb_c", "usb3", "usb", "any"]


def _has(col: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col, F.lit(w))
    return out


def branch(interface: str, speed: str) -> Column:
    """The branch that a request takes: the first of video, high speed, ethernet and usb that its text names, else any."""
    i, s = F.lower(F.trim(F.coalesce(F.col(interface), F.lit("")))), F.lower(F.trim(F.coalesce(F.col(speed), F.lit(""))))
    ten = F.contains(i, F.lit("10g")) | F.contains(s, F.lit("10g")) | F.contains(s, F.lit("cat6a"))
    fast, ethernet = ten | _has(i, WORDS["fast"]), _has(i, WORDS["ethernet"])
    three = _has(i, ["usb3", "usb 3", "superspeed"]) | F.contains(s, F.lit("3"))
    usb = F.when(_has(i, WORDS["usb_c"]), "usb_c").when(three, "usb3").otherwise("usb")
    return (
        F.when(_has(i, WORDS["hdmi"]), "hdmi")
        .when(_has(i, WORDS["displayport"]), "displayport")
        .when(fast & ethernet, "fast_ethernet")
        .when(fast, "fast")
        .when(ethernet, "ethernet")
        .when(_has(i, WORDS["usb"]), usb)
        .otherwise("any")
    )


def branches_served(interface: str, family: str) -> Column:
    """The branches whose requests a family can serve, an array: so requests meet families by equality."""
    i, f = F.lower(F.coalesce(F.col(interface), F.lit(""))), F.lower(F.coalesce(F.col(family), F.lit("")))
    has = lambda *words: _has(i, list(words))
    fast = _has(i, FAST_INTERFACE) | _has(f, FAST_FAMILY)
    ethernet = has("ethernet", "rj45")
    serves = {
        "hdmi": has("hdmi"),
        "displayport": has("displayport") | F.contains(f, F.lit("dp")),
        "fast_ethernet": fast | ethernet,
        "fast": fast,
        "ethernet": ethernet,
        "usb_c": has("usb") & (has("usb-c", "usb 3.2") | F.contains(f, F.lit("usb3cftv"))),
        "usb3": has("usb") & ~(has("2.0") & ~has("3")),
        "usb": has("usb"),
        "any": F.lit(True),
    }
    return F.array_compact(F.array(*[F.when(serves[b], b) for b in BRANCHES]))


def numbered_wishes(requests: DataFrame, wishes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests that wish the same are one: (``request``, wishes) of the different ones, and (own columns, ``wish``) of all.

    Nulls equal each other. A wish's number is the least ``request`` that has it, so ``relax`` takes the first
    table as its requests, and its work follows how many different wishes there are.
    """
    different = requests.groupBy(*wishes).agg(F.min("request").alias("request"))
    key = F.struct(*wishes)
    numbers = different.select(F.col("request").alias("wish"), key.alias("__key"))
    return different, requests.withColumn("__own", key).join(numbers, F.col("__own").eqNullSafe(F.col("__key"))).drop("__own", "__key")


def relax(requests: DataFrame, families: DataFrame, wishes: dict[str, Column], broadcast_rows: int = 100_000) -> DataFrame:
    """(request, family columns, ``depth``, ``given_up``): the families that keep most of each request's wishes.

    Requests have (request, branch, ...), families (served, ...). ``wishes`` are named conditions
    on both sides' columns, the dearest first; a null condition is no wish and counts as met. A
    family's depth is how many wishes it meets before the first that it does not. Only families of the
    greatest depth stay for a request, and ``given_up`` lists the wishes after it that are not met by
    all of them. A request whose branch no family serves has one row without a depth.
    """
    right = families.withColumns({"branch": F.explode("served"), "__family": F.lit(True)}).drop("served")
    right = F.broadcast(right) if families.count() <= broadcast_rows else right
    met = F.array(*[F.coalesce(c, F.lit(True)) for c in wishes.values()])
    served = F.col("__family").isNotNull()
    pairs = requests.join(right, "branch", "left").withColumn("__met", F.when(served, met))
    first = F.array_position("__met", F.lit(False))
    pairs = pairs.withColumn("depth", F.when(served, F.when(first == 0, F.lit(len(wishes))).otherwise(first - 1).cast("int")))
    every = F.array(*[F.bool_and(F.get("__met", F.lit(i))) for i in range(len(wishes))])
    # depth by depth, which wishes all families of that depth meet; then the greatest depth of a request
    best = pairs.where("depth IS NOT NULL").groupBy("request", "depth").agg(every.alias("__all")).groupBy("request").agg(F.max_by("__all", "depth").alias("__all"), F.max("depth").alias("__best"))
    names = F.array(*[F.lit(n) for n in wishes])
    given = F.transform(F.filter(F.arrays_zip(names.alias("n"), F.col("__all").alias("ok")), lambda w: ~w["ok"]), lambda w: w["n"])
    out = pairs.join(best, "request", "left").where("depth IS NULL OR depth = __best")
    return out.withColumn("given_up", F.when(F.col("__all").isNotNull(), given)).drop("__met", "__all", "__best", "__family")
