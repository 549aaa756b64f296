"""From requirements to ranked arrangements with part numbers.

A request's needs are served size by size, in the order in which the sizes were first asked
for: from the size itself, else from the next larger one with room, else, for a power load,
by another number of contacts of another size. What is left is carried along, so the
service is a fold inside a row. Needs and arrangements of the same content are decided once,
and only against arrangements whose contacts can suffice at all (``ranges.at_least``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.operators import ranges, requirements
from partlake.operators.electrical import POWER_SIZES
from partlake.scratch import Scratch

# --- fixed values: sizes from the smallest contact to the largest
SIZE_ORDER = ["22D", "22", "20", "16", "12", "8", "4", "0"]
#: Distinct arrangements up to which they are broadcast, some 500 bytes each.
BROADCAST_SHAPES = 50_000

_USE = "struct<size:string,at:string,contacts:bigint,kind:string>"


def needs_in_order(expanded: DataFrame) -> DataFrame:
    """(request, ``needs``): (size, contacts, rail_amps, rails) in the order in which the sizes were asked for.

    ``rail_amps`` is the largest load of the size's power rails, ``rails`` their number, with
    the returns that were added for them; both are of power loads, not of returns asked for.
    """

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, r: acc + value(r))

    def need(s: Column) -> Column:
        own = F.filter("rows", lambda r: r["size"] == s)
        power = F.filter(own, lambda r: r["function"] == "power")
        back = F.filter(own, lambda r: (r["function"] == "power_return") & F.exists("rows", lambda p: (p["function"] == "power") & (p["pos"] == r["pos"])))
        contacts = total(own, lambda r: r["per"].cast("long") * r["instances"])
        rails = total(power, lambda r: r["instances"].cast("long")) + total(back, lambda r: r["instances"].cast("long"))
        return F.struct(s.alias("size"), contacts.alias("contacts"), F.array_max(F.transform(power, lambda r: r["amps"])).alias("rail_amps"), rails.alias("rails"))

    sizes = F.array_distinct(F.transform("rows", lambda r: r["size"]))
    return expanded.select("request", F.transform(sizes, need).alias("needs"))


def _forced(amps: Column, other: Column) -> list[tuple[str, Column]]:
    """Contacts of each power size, the largest first, that carry a load."""
    return [(s, requirements.forced_contacts(amps, s, other).cast("long")) for s in reversed(POWER_SIZES)]


def least_contacts(needs: str) -> Column:
    """Contacts without which an arrangement cannot serve the needs: a power load counts by the size that takes fewest."""

    def one(n: Column) -> Column:
        fewest = F.least(*[c for _, c in _forced(n["rail_amps"], F.lit(0))]) * n["rails"]
        return F.when(n["rails"] > 0, F.least(n["contacts"], fewest)).otherwise(n["contacts"])

    return F.aggregate(F.transform(needs, one), F.lit(0).cast("long"), lambda a, x: a + x)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def serve(df: DataFrame, needs: str, have: str) -> DataFrame:
    """Add ``served`` (rest, used, fits, uses): what the needs take of an arrangement (map of size to contacts), in order, and what is left.

    A use is (size, at, contacts, kind) with kind exact, upsized or split. A split takes, of the
    power sizes from the largest, the first that can carry the size's largest load beside the
    contacts taken so far and has room for all its rails. The first need without room ends it.
    """
    order = F.array(*[F.lit(s) for s in SIZE_ORDER])
    state = f"struct<rest:map<string,bigint>,used:bigint,fits:boolean,uses:array<{_USE}>>"

    def step(acc: Column, n: Column) -> Column:
        def room(s: Column) -> Column:
            return F.coalesce(F.try_element_at(acc["rest"], s), F.lit(0))

        def use(at: Column, contacts: Column, kind: str) -> Column:
            return F.struct(n["size"].alias("size"), at.alias("at"), contacts.cast("long").alias("contacts"), F.lit(kind).alias("kind"))

        larger = F.filter(F.slice(order, F.array_position(order, n["size"]).cast("int") + 1, len(SIZE_ORDER)), lambda s: room(s) >= n["contacts"])
        larger = F.when(F.array_position(order, n["size"]) > 0, F.get(larger, F.lit(0)))
        others = F.array(*[F.struct(F.lit(s).alias("s"), (c * n["rails"]).alias("c")) for s, c in _forced(n["rail_amps"], acc["used"])])
        split = F.get(F.filter(others, lambda o: (o["s"] != n["size"]) & (room(o["s"]) >= o["c"])), F.lit(0))
        chosen = (
            F.when(room(n["size"]) >= n["contacts"], use(n["size"], n["contacts"], "exact"))
            .when(larger.isNotNull(), use(larger, n["contacts"], "upsized"))
            .when((n["rails"] > 0) & n["rail_amps"].isNotNull(), _let(split, lambda o: F.when(o.isNotNull(), use(o["s"], o["c"], "split"))))
        )

        def taken(u: Column) -> Column:
            return F.struct(
                F.transform_values(acc["rest"], lambda k, v: F.when(k == u["at"], v - u["contacts"]).otherwise(v)).alias("rest"),
                (acc["used"] + u["contacts"]).alias("used"),
                F.lit(True).alias("fits"),
                F.concat(acc["uses"], F.array(u)).alias("uses"),
            )

        over = F.struct(acc["rest"].alias("rest"), acc["used"].alias("used"), F.lit(False).alias("fits"), acc["uses"].alias("uses"))
        served = _let(chosen, lambda u: F.when(u.isNull(), over).otherwise(taken(u)))
        return F.when(acc["fits"], served).otherwise(acc).cast(state)

    start = F.struct(F.col(have).alias("rest"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("fits"), F.array().cast(f"array<{_USE}>").alias("uses")).cast(state)
    return df.withColumn("served", F.aggregate(needs, start, step))


def shapes(contacts: DataFrame, key: str) -> DataFrame:
    """(key, ``have``, ``total``): contacts by size of each arrangement, given as rows (key, size, count)."""
    per = contacts.groupBy(key, "size").agg(F.sum("count").cast("long").alias("n"))
    one = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("have"), F.sum("n").alias("total"))
    return one


def suggest(requests: DataFrame, contacts: DataFrame, key: str, spare_percent: int = 15, top: int = 5, broadcast_shapes: int = BROADCAST_SHAPES) -> DataFrame:
    """(request, place, key, ``total``, ``uses``, ``splits``, ``upsizes``, ``spare``, ``meets_spare``) of the best ``top`` arrangements of each request.

    ``requests`` is as for ``requirements.expand``, ``contacts`` has rows (key, size, count). Ranked
    are arrangements that fit: without a split first, then fewest upsized sizes, then those that
    leave as many contacts as wanted, then most spare, fewest contacts, the key. A request
    that no arrangement serves has one row without a place.
    """
    # folds are written once each, as the optimizer would write them out again wherever their result is used
    scratch = Scratch(requests.sparkSession, "suggestion")
    expanded = scratch.write(requirements.expand(requests), "expanded")
    needed = scratch.write(needs_in_order(expanded), "needs", keep=True)
    scratch.drop(expanded)
    needed = needed.withColumn("total", F.aggregate("needs", F.lit(0).cast("long"), lambda a, n: a + n["contacts"]))
    kinds = needed.select("needs", "total").distinct().withColumn("least", least_contacts("needs"))
    made = shapes(contacts, key)
    alike = made.select("have", F.col("total").alias("cavities")).distinct()
    alike = F.broadcast(alike) if alike.count() <= broadcast_shapes else alike
    pairs = ranges.at_least(kinds, alike, "least", "cavities").withColumn("__have", F.map_from_entries("have"))
    # the fold is much work on few bytes, which adaptive execution would put into one task
    pairs = pairs.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fitted = scratch.write(serve(pairs, "needs", "__have"), "served", keep=True).where("served.fits")
    fitted = fitted.select("*", "served.uses", "served.rest")
    spare = F.aggregate(F.map_values("rest"), F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0)))
    of_kind = lambda k: F.size(F.filter("uses", lambda u: u["kind"] == k))
    wanted = requirements.spare_target(F.col("total"), F.lit(spare_percent))
    scored = fitted.select("needs", "total", "have", "cavities", "uses", of_kind("split").alias("splits"), of_kind("upsized").alias("upsizes"), spare.alias("spare"))
    scored = scored.withColumn("meets_spare", F.col("spare") >= wanted)
    rank = [(F.col("splits") > 0).cast("int"), F.col("upsizes"), (~F.col("meets_spare")).cast("int"), F.desc("spare"), F.col("cavities")]
    # more arrangements of one content than are wanted cannot change the best, so they are cut before the join
    first = Window.partitionBy("have").orderBy(key)
    named = made.select(key, "have").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= top).drop("__n")
    best = Window.partitionBy("needs").orderBy(*rank, key)
    ranked = scored.join(named, "have").withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    cols = ["place", key, "uses", "splits", "upsizes", "spare", "meets_spare"]
    return needed.join(ranked.select("needs", *cols), "needs", "left").select("request", "total", *cols)
