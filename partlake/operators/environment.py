"""Service-environment classification of decoded part numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake import refdata as R

# --- fixed values: environments of every connector with their suitability, and those by salt-spray hours
ALWAYS = [
    ("aerospace_general", "recommended"), ("aircraft_fixed_wing", "recommended"), ("land_general", "recommended"),
    ("land_military", "recommended"), ("land_vehicle", "acceptable"), ("desert_dust", "conditional"), ("high_vibration", "recommended"),
    ("high_shock", "recommended"), ("industrial", "recommended"), ("fuel_oil_hydraulic_exposure", "recommended"),
    ("low_temperature", "recommended"), ("sealed_weatherproof", "conditional"),
]
#: By salt-spray hours of the class.
SALT = {
    2000: [("salt_fog", "recommended"), ("coastal", "recommended"), ("marine_above_deck", "acceptable"), ("outdoor_exposed", "recommended")],
    500: [("salt_fog", "acceptable"), ("coastal", "acceptable"), ("marine_above_deck", "conditional"), ("outdoor_exposed", "acceptable")],
    48: [("salt_fog", "not_recommended"), ("outdoor_exposed", "conditional")],
}


def _score(name: str) -> int:
    return dict(R.SUITABILITY)[name]


def _rows(pairs: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(e).alias("environment"), F.lit(_score(s)).alias("score")) for e, s in pairs])


def class_facts(spark) -> DataFrame:
    return spark.createDataFrame(R.CLASS_FACTS, "fact_class string, max_temp int, salt_hours int, conductive boolean, space_grade boolean")


def profiles(decoded: DataFrame) -> DataFrame:
    """(all columns, ``environment``, ``score``): the graded environments of each row, repeats not yet resolved.

    Accessories get the single unknown one. Everything is an array of literals chosen by
    conditions and exploded once, so the classification adds no shuffle.
    """
    facts = F.broadcast(class_facts(decoded.sparkSession))  # a dozen fixed rows
    j = decoded.join(facts, F.col("class") == F.col("fact_class"), "left")
    none = F.array().cast("array<struct<environment:string,score:int>>")
    on = lambda cond, pairs: F.when(cond, _rows(pairs)).otherwise(none)
    hermetic, emi = F.col("sheet").isin(R.HERMETIC_SHEETS), F.col("sheet").isin(R.EMI_SHEETS)
    conductive = F.coalesce(F.col("conductive"), F.lit(True))
    space = F.coalesce(F.col("space_grade"), F.lit(False))
    parts = [
        _rows(ALWAYS),
        on(F.coalesce(F.col("max_temp"), F.lit(0)) == 200, [("high_temperature", "recommended")]),
        on(F.coalesce(F.col("max_temp"), F.lit(0)) == 175, [("high_temperature", "acceptable")]),
        on(emi, [("high_emi_rfi", "recommended")]),
        on(~emi & conductive, [("high_emi_rfi", "conditional")]),
        on(~emi & ~conductive, [("high_emi_rfi", "not_recommended")]),
        on(space, [("space", "acceptable")]),
        on(hermetic | space, [("vacuum", "acceptable")]),
        on(hermetic, [("industrial", "recommended")]),
        on(F.col("class").isin("K", "S"), [("high_temperature", "recommended")]),
        *[on(F.coalesce(F.col("salt_hours"), F.lit(0)) == h, pairs) for h, pairs in SALT.items()],
    ]
    accessory = F.col("sheet").isin(R.ACCESSORY_SHEETS)
    graded = F.when(accessory, _rows([("unknown_environment", "unknown")])).otherwise(F.concat(*parts))
    out = j.withColumn("__g", F.explode(graded))
    return out.select(*decoded.columns, F.col("__g.environment").alias("environment"), F.col("__g.score").alias("score"))


def best_profiles(graded: DataFrame, key: str) -> DataFrame:
    """One row for a key and environment: the best grade."""
    return graded.groupBy(key, "environment").agg(F.max("score").alias("score"))


def tag_rank() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for i, t in enumerate(R.TAGS) for x in (t, i)]), F.col("environment"))


def tags(best: DataFrame, key: str) -> DataFrame:
    """(key, ``tags``): environments graded conditional or better, in the fixed order, joined by commas."""
    good = best.where("score >= 3").withColumn("rank", tag_rank())
    ordered = F.array_sort(F.collect_list(F.struct("rank", "environment")))
    return good.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["environment"]), ",").alias("tags"))


def group_scores(best: DataFrame, key: str) -> DataFrame:
    """(key, land, sea, air, space, industrial): the best grade in each group, 0 without one."""
    cols = [F.max(F.when(F.col("environment").isin(envs), F.col("score")).otherwise(F.lit(0))).alias(name) for name, envs in R.SCORE_GROUPS]
    return best.groupBy(key).agg(*cols)


def top_environment(best: DataFrame, key: str) -> DataFrame:
    """The best environment of each key, ties by the fixed order."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), tag_rank())
    return best.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


# --- the report row ------------------------------------------------------------------------
# --- fixed values: what is said of sealed and hermetic connectors
SEALED = ["environmentally sealed when wired, mated and fitted", "altitude-immersion qualified in the mated condition"]
HERMETIC = ["hermetic solder contacts", "glass-to-metal seal barrier"]
FLUIDS = ["oil", "hydraulic fluid", "jet fuel", "de-icing fluid", "cleaning agents"]


def series_of(stated, sheet) -> Column:
    """A document's series, else IV for sheets in the forties, else III."""
    return F.coalesce(F.nullif(stated, F.lit("")), F.when(F.col(sheet).startswith("4"), "IV").otherwise("III"))


def features(decoded: DataFrame) -> DataFrame:
    """Add ``sealing``, ``emi``, ``corrosion``, ``shock``, ``fluids`` and ``vacuum``: arrays of texts; accessories have the finish alone."""
    facts = F.broadcast(class_facts(decoded.sparkSession))  # a dozen fixed rows
    j = decoded.join(facts, F.col("class") == F.col("fact_class"), "left")
    accessory, hermetic, emi = F.col("sheet").isin(R.ACCESSORY_SHEETS), F.col("sheet").isin(R.HERMETIC_SHEETS), F.col("sheet").isin(R.EMI_SHEETS)
    texts = lambda xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    hours = F.when(F.col("salt_hours") > 0, F.concat(F.col("salt_hours").cast("string"), F.lit("-hour salt spray")))
    finish = F.concat(F.lit("class "), F.col("class"), F.lit(" finish"))
    coupling = F.when(series_of(F.lit(None).cast("string"), "sheet") == "IV", "breech coupling").otherwise("threaded coupling")
    conductive = F.coalesce(F.col("conductive"), F.lit(True))
    lists = {
        "sealing": F.when(hermetic, texts(HERMETIC)).otherwise(texts(SEALED)),
        "emi": F.when(emi, texts(["EMI grounding feature"])).when(conductive, texts(["conductive shell finish"])).otherwise(texts(["nonconductive finish"])),
        "corrosion": F.array_compact(F.array(hours, finish)),
        "shock": F.array(F.lit("300 G half-sine shock"), coupling),
        "fluids": F.when(hermetic, texts(["fuel", *FLUIDS[:2]])).otherwise(texts(FLUIDS)),
        "vacuum": F.array_compact(F.array(F.when(F.coalesce("space_grade", F.lit(False)), "space-grade finish"), F.when(hermetic, HERMETIC[1]))),
    }
    out = {n: F.when(accessory, F.array(finish) if n == "corrosion" else none).otherwise(c) for n, c in lists.items()}
    return j.select(*decoded.columns, *[c.alias(n) for n, c in out.items()])


def notes(scores: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """(key, ``notes``): sentences by the group scores; vacuum and weak salt fog are looked up among the best grades."""
    grade = lambda e: F.max(F.when(F.col("environment") == e, F.col("score")))
    more = best.groupBy(key).agg(grade("vacuum").alias("v"), grade("salt_fog").alias("f"), F.bool_and(F.col("environment") == "unknown_environment").alias("unknown"))
    j = scores.join(more, key)
    said = F.concat_ws(
        " ",
        F.when(F.col("air") >= 4, "Suitable for aerospace service."),
        F.when(F.col("land") >= 4, "Matched to rugged land service."),
        F.when(F.col("sea") >= 4, "Finish supports salt-fog exposure.").when(F.col("sea") == 3, "Marine use is conditional.").when(F.col("f") == 1, "Finish is weak in salt fog."),
        F.when(F.col("industrial") >= 4, "Industrial fluids are supported."),
        F.when(F.col("space") >= 4, "Space evidence is explicit.").when(F.col("v") >= 3, "Vacuum is documented.").otherwise("No space-grade evidence."),
    )
    return j.select(key, F.when(F.col("unknown"), "Accessory; environment was not classified.").otherwise(said).alias("notes"))
