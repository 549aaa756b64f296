"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table there and reading it
back, so a lost executor costs a re-read, never a recomputation of everything.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="partlake-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


class Scratch:
    """Named tables of one run of an operator; ``keep`` survives ``clear``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []

    def new_path(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = self.new_path(name)
        df.write.parquet(path)
        if not keep:
            self._paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)
            self._paths = [p for p in self._paths if p != t._scratch_path]

    def clear(self) -> None:
        for p in self._paths:
            self._delete(p)
        self._paths = []

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
