"""From a list of electrical requirements to contacts, pins, spare targets, part numbers and notes.

A request is a handful of rows. They are folded in order inside one row of the table, as the
contacts of a power rail depend on how many contacts come before it; requests are
independent, so the only shuffle is the one that brings a request's rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake import refdata as R
from partlake.functions.math import spare_target
from partlake.operators.electrical import _enough, derating, power_contacts

# --- fixed values: contacts of a function (size, number, signals)
FUNCTIONS = {
    "discrete": ("22D", 1, []),
    "ethernet_1g": ("22D", 9, ["BI_DA+", "BI_DA-", "BI_DB+", "BI_DB-", "BI_DC+", "BI_DC-", "BI_DD+", "BI_DD-", "SHIELD/DRAIN"]),
    "ethernet_100m": ("22D", 5, ["TX+", "TX-", "RX+", "RX-", "SHIELD/DRAIN"]),
    "uart": ("22D", 3, ["TX", "RX", "GND"]),
    "i2c": ("22D", 3, ["SDA", "SCL", "GND"]),
    "spi": ("22D", 5, ["SCLK", "MOSI", "MISO", "CS", "GND"]),
    "rs485": ("22D", 3, ["A(D-)", "B(D+)", "GND"]),
    "rs485_full": ("22D", 5, ["TX+", "TX-", "RX+", "RX-", "GND"]),
    "rs422": ("22D", 5, ["TX+(Y)", "TX-(Z)", "RX+(A)", "RX-(B)", "GND"]),
    "rs232": ("22D", 3, ["TXD", "RXD", "GND"]),
    "rs232_full": ("22D", 8, ["TXD", "RXD", "RTS", "CTS", "DTR", "DSR", "DCD", "GND"]),
    "can_bus": ("22D", 3, ["CAN_H", "CAN_L", "GND"]),
    "coax": ("12 Coax", 1, []),
    "twinax": ("8 Twinax", 1, []),
}
# --- fixed values: slash sheets by connector type and series
SHEETS = {("plug", "III"): "26", ("plug", "IV"): "46", ("jam_nut_receptacle", "III"): "24", ("jam_nut_receptacle", "IV"): "44", ("wall_mount_receptacle", "III"): "20", ("wall_mount_receptacle", "IV"): "40"}

_ROW = "struct<pos:int,function:string,size:string,per:int,instances:int,amps:double>"


def _pick(names: Column, values: dict[str, object]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), names)


def _rail(amps: Column, other: Column) -> Column:
    """(size, n) of one rail; beyond what 49 of the largest carry, as many of it as its rating beside 20 others asks for."""
    largest = dict((s, a) for s, a, *_ in R.RATINGS)["12"]
    many = F.struct(F.lit("12").alias("size"), (F.floor(amps / (largest * derating(other + 20))) + 1).cast("int").alias("n"))
    one = F.struct(F.lit("22D").alias("size"), F.lit(1).alias("n"))
    return F.when(amps <= 0, one).otherwise(F.coalesce(power_contacts(amps, other), many))


def forced_contacts(amps: Column, size: str, other: Column) -> Column:
    """The fewest contacts of the given size that carry a load, up to 20; null if they cannot."""
    rated = {s: a for s, a, *_ in R.RATINGS}.get(size)
    if not rated:
        return F.lit(None).cast("int")
    return F.array_min(F.filter(F.sequence(F.lit(1), F.lit(20)), _enough(rated, amps, other)))


def expand(requests: DataFrame) -> DataFrame:
    """(request, ``rows``): the contacts of each requirement in order, then returns for the power rails.

    ``requests`` has request, pos, function, count, amps. Unknown functions are discrete. A
    request with power and without a return of its own gets equal returns.
    """
    row = F.struct("pos", "function", "count", F.coalesce("amps", F.lit(0.0)).alias("amps"))
    one = requests.groupBy("request").agg(F.array_sort(F.collect_list(row)).alias("asked"))

    def step(acc: Column, r: Column) -> Column:
        power = r["function"].isin("power", "power_return")
        size = F.coalesce(_pick(r["function"], {f: s for f, (s, _, _) in FUNCTIONS.items()}), F.lit("22D"))
        per = F.coalesce(_pick(r["function"], {f: n for f, (_, n, _) in FUNCTIONS.items()}), F.lit(1))
        chosen = F.when(power, _rail(r["amps"], acc["total"])).otherwise(F.struct(size.alias("size"), per.alias("n")))

        def added(c: Column) -> Column:
            made = F.struct(r["pos"].cast("int").alias("pos"), r["function"].alias("function"), c["size"].alias("size"), c["n"].cast("int").alias("per"), r["count"].cast("int").alias("instances"), r["amps"].alias("amps"))
            return F.struct((acc["total"] + c["n"] * r["count"]).cast("long").alias("total"), F.concat(acc["rows"], F.array(made)).alias("rows"))

        return F.get(F.transform(F.array(chosen), added), F.lit(0))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(f"array<{_ROW}>").alias("rows"))
    folded = F.aggregate("asked", start, step, lambda acc: acc["rows"])
    rails = F.filter("rows", lambda r: r["function"] == "power")
    back = F.transform(rails, lambda r: F.struct(r["pos"], F.lit("power_return").alias("function"), r["size"], r["per"], r["instances"], r["amps"]))
    own = F.exists("rows", lambda r: r["function"] == "power_return")
    return one.select("request", folded.alias("rows")).select("request", F.when(own, F.col("rows")).otherwise(F.concat("rows", back.cast(f"array<{_ROW}>"))).alias("rows"))


def needs(expanded: DataFrame) -> DataFrame:
    """(request, size, contacts, rail_amps, rails): contacts by size, with the largest load and the number of rails of that size."""
    r = expanded.select("request", F.explode("rows").alias("r")).select("request", "r.*")
    power = F.col("function").isin("power", "power_return")
    return r.groupBy("request", "size").agg(
        F.sum(F.col("per") * F.col("instances")).alias("contacts"), F.max(F.when(power, F.col("amps"))).alias("rail_amps"), F.sum(F.when(power, F.col("instances")).otherwise(0)).alias("rails")
    )


def spares(needed: DataFrame, percent: int) -> DataFrame:
    """(request, total, target): contacts in all and how many cavities should stay free."""
    total = needed.groupBy("request").agg(F.sum("contacts").alias("total"))
    return total.withColumn("target", spare_target(F.col("total"), F.lit(percent)))


def pins(expanded: DataFrame) -> DataFrame:
    """(request, signal, function, size, color): one row a contact."""
    r = expanded.select("request", F.explode("rows").alias("r")).select("request", "r.*")
    r = r.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest("instances", F.lit(1))))).where("instances > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("per"))))
    signals = F.array(*[F.struct(F.lit(f).alias("f"), F.array(*[F.lit(x) for x in s]).cast("array<string>").alias("s")) for f, (_, _, s) in FUNCTIONS.items()])
    named = F.get(F.filter(signals, lambda x: x["f"] == F.col("function")), F.lit(0))["s"]
    number = F.when(F.col("instances") > 1, F.concat(F.lit(" #"), F.col("i").cast("string"))).otherwise("")
    rail = F.when(F.col("instances") > 1, F.concat(F.lit(" rail #"), F.col("i").cast("string"))).otherwise("")
    parallel = F.when(F.col("per") > 1, F.concat(F.lit(" p"), F.col("j").cast("string"))).otherwise("")
    signal = (
        F.when(F.col("function") == "power", F.concat(F.lit("V+"), rail, parallel))
        .when(F.col("function") == "power_return", F.concat(F.lit("V-/RTN"), rail, parallel))
        .when(F.size(named) > 0, F.concat(F.get(named, F.col("j") - 1), number))
        .when(named.isNotNull(), F.concat(F.upper("function"), number))
        .otherwise(F.concat("function", F.lit(" #"), F.col("i").cast("string")))
    )
    color = F.when(F.col("function") == "power", "RED").when(F.col("function") == "power_return", "BLACK").otherwise("")
    return r.select("request", signal.alias("signal"), "function", "size", color.alias("color"))


def candidate_number(kind: Column, series: Column, cls: Column, size_number: Column, number: Column, contact: str) -> Column:
    """The part number of an arrangement; unknown types are straight plugs of series III; the key is always N."""
    sheet = F.coalesce(_pick(F.concat(kind, F.lit("|"), series), {f"{k}|{s}": v for (k, s), v in SHEETS.items()}), F.lit("26"))
    code = F.coalesce(_pick(size_number, {n: c for c, n in R.SHELL_SIZES}), F.lit("?"))
    return F.concat(F.lit("D38999/"), sheet, cls, code, number, F.lit(contact + "N"))


def design_notes(requests: DataFrame) -> DataFrame:
    """(request, notes): what a designer should look at, by the functions asked for."""
    has = lambda *fs: F.bool_or(F.col("function").isin(*fs))
    one = requests.groupBy("request").agg(
        has("ethernet_1g").alias("fast"), has("rs485", "rs485_full", "can_bus").alias("bus"), has("power").alias("power"),
        F.bool_or((F.col("function") == "power") & (F.col("amps") > 13)).alias("strong"), F.sum(F.when(F.col("function") == "power", F.col("count") * F.col("amps"))).alias("budget"),
    )
    notes = F.array(
        F.when(F.col("fast"), "validate the cable assembly for gigabit signals"),
        F.when(F.col("bus"), "keep bus pairs adjacent and terminate the ends"),
        F.when(F.col("strong"), "check the temperature at full load"),
        F.when(F.col("power"), F.concat(F.lit("power budget "), F.format_number(F.col("budget"), 1), F.lit(" A"))),
    )
    return one.select("request", F.array_compact(notes).alias("notes"))
