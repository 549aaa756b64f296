"""JSON arrays in shards of bounded size, with an index that names them.

Each task writes its rows, in order, into files of at most so many bytes, under names of its own;
the commit, on the driver, writes the index out of the tasks' reports and removes what the index
does not name: older shards, and what a lost task has left. So a reader who follows the index
never sees half a table.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

META = "_sharding"
#: Bytes of a shard.
MAX_BYTES = 42 << 20


def _place(path: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    shards: list[tuple[str, int, int]]  # name, records, bytes


class ShardWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.key = options["array_key"]
        self.prefix = options.get("prefix") or re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", self.key).lower()
        self.most = int(options.get("max_bytes", MAX_BYTES))
        self.extra = options.get("extra", "{}")

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, folder = _place(self.path)
        fs.create_dir(folder, recursive=True)
        part, attempt, shards = TaskContext.get().partitionId(), uuid.uuid4().hex, []
        held: list[bytes] = []
        size = 2

        def flush() -> None:
            name = f"{self.prefix}_{part:06d}_{len(shards):05d}-{attempt}.json"
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(b"[" + b",".join(held) + b"]\n")
            shards.append((name, len(held), size))

        for row in iterator:
            record = row[0].encode()
            if held and size + len(record) + 2 > self.most:
                flush()
                held, size = [], 2
            held.append(record)
            size += len(record) + 2
        if held:
            flush()
        return Written(part, shards)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _place(self.path)
        fs.create_dir(folder, recursive=True)
        shards = [s for m in sorted((m for m in messages if m), key=lambda m: m.part) for s in m.shards]
        meta = {"array_key": self.key, "record_count": sum(n for _, n, _ in shards), "shard_count": len(shards), "max_shard_bytes": self.most, "shards": [s for s, _, _ in shards]}
        with fs.open_output_stream(f"{folder}/index.json") as f:
            f.write(json.dumps(json.loads(self.extra) | {META: meta}, ensure_ascii=False, indent=2).encode() + b"\n")
        self._remove(lambda name: name not in {"index.json", *meta["shards"]})

    def abort(self, messages: list[Written | None]) -> None:
        own = {s for m in messages if m for s, _, _ in m.shards}
        self._remove(own.__contains__)

    def _remove(self, wanted) -> None:
        from pyarrow.fs import FileSelector

        fs, folder = _place(self.path)
        for f in fs.get_file_info(FileSelector(folder)):
            if f.is_file and f.base_name.endswith(".json") and wanted(f.base_name):
                fs.delete_file(f.path)


class ShardSource(DataSource):
    """Write format ``json_shards``: a table of one text column, each a JSON record."""

    @classmethod
    def name(cls) -> str:
        return "json_shards"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options))


def write_shards(df: DataFrame, path: str, array_key: str, order: list[str], max_bytes: int = MAX_BYTES, extra: dict | None = None) -> None:
    """``df`` as shards of JSON arrays in the order of ``order``, and ``index.json``, which replaces what the folder held.

    A shard has at most ``max_bytes`` bytes, two a record for what parts records included, or
    one larger record. Null members are left out. ``extra`` are further members of the index.
    Tasks reach the folder through pyarrow's file systems, so it must be one that all of them share.
    """
    spark = df.sparkSession
    spark.dataSource.register(ShardSource)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    body = ranged.select(F.to_json(F.struct(*[f"`{c}`" for c in df.columns])).alias("value"))
    out = body.write.format("json_shards").mode("overwrite").option("array_key", array_key).option("max_bytes", max_bytes)
    out.option("extra", json.dumps(extra or {})).option("path", path).save()


def read_index(path: str) -> dict:
    fs, folder = _place(path)
    with fs.open_input_stream(f"{folder}/index.json") as f:
        return json.loads(f.read())


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records that the index names; an index without shards is an empty table."""
    shards = read_index(path)[META]["shards"]
    if not shards:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json([f"{path.rstrip('/')}/{s}" for s in shards])


def write_bundle(tables: dict[str, tuple[DataFrame | None, list[str]]], path: str, max_bytes: int = MAX_BYTES) -> None:
    """Several tables with their orders under one index: ``index.json`` maps each name to its shards' meta data.

    What is missing (None) is told in one error before anything is written.
    """
    missing = sorted(n for n, (df, _) in tables.items() if df is None)
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))
    for name, (df, order) in tables.items():
        write_shards(df, f"{path}/{name}", name, order, max_bytes)
    fs, folder = _place(path)
    with fs.open_output_stream(f"{folder}/index.json") as f:
        f.write(json.dumps({n: read_index(f"{path}/{n}")[META] for n in tables}, indent=2).encode())


def write_details_and_list(df: DataFrame, path: str, key: str, listed: str, max_bytes: int = MAX_BYTES) -> None:
    """The rows by ``key``, and the different values of ``listed`` in the same order, each with its number in the index."""
    write_shards(df, f"{path}/details", "details", [key], max_bytes, {"count": df.count()})
    names = df.groupBy(listed).agg(F.min(key).alias("__key"))
    write_shards(names.where(F.col(listed).isNotNull()), f"{path}/list", "list", ["__key", listed], max_bytes, {"count": names.count()})
