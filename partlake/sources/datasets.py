"""Readers and writers of the catalog's file formats: sharded JSON, JSON lines, CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_array_document(spark: SparkSession, path: str, array_key: str, row: T.StructType) -> DataFrame:
    """Rows of the array under ``array_key`` of a JSON document, or of all documents of a folder, in file and array order."""
    schema = T.StructType([T.StructField(array_key, T.ArrayType(row))])
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    out = docs.select(F.input_file_name().alias("__file"), F.posexplode(array_key).alias("__pos", "r"))
    return out.select("__file", "__pos", "r.*").orderBy("__file", "__pos").drop("__file", "__pos")


def read_json_lines(spark: SparkSession, path: str, row: T.StructType, key: str) -> DataFrame:
    """A cache of JSON lines: blank and broken lines are skipped, the last line of a key wins."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    parsed = lines.where(F.trim("value") != "").select("f", "n", F.from_json("value", row).alias("r"))
    parsed = parsed.where(F.col(f"r.{key}").isNotNull())
    return parsed.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by("r", F.struct("f", "n")).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_shards(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Parquet part files of bounded size; readers see one table."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """Quoted CSV with a header and CRLF line ends; nothing is written for an empty table."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)
    return True


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_array_document(df: DataFrame, path: str, order: list[str], rows_per_file: int, array_key: str) -> None:
    """Sharded JSON documents ``{array_key: [...]}`` in order, about ``rows_per_file`` rows each.

    A range partition holds consecutive rows and becomes one document, so no task sees
    more than a shard.
    """
    n = max(1, -(-df.count() // rows_per_file))
    row = F.struct(*df.columns)
    ranged = df.repartitionByRange(n, *order).select(F.spark_partition_id().alias("shard"), F.struct(*order).alias("o"), row.alias("r"))
    shards = ranged.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("o", "r"))).alias("x"))
    body = shards.select("shard", F.transform("x", lambda e: e["r"]).alias(array_key))
    body.repartitionByRange(n, "shard").drop("shard").write.mode("overwrite").json(path)


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder a table; surrogate ids are explicit columns, so they are the same on every run."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
