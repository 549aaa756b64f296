"""Cutting Arrow batches, so that what a Python worker holds at once stays small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of an Arrow batch of texts.
TEXT_ROWS = 500


def slices_by_bytes(batch: pa.RecordBatch, text: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes in column ``text`` each; one row at least."""
    n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(n)
    at = 0
    while at < batch.num_rows:
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + size)))
        yield batch.slice(at, end - at)
        at = end


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches to ``TEXT_ROWS`` rows.

    Spark's default of 10,000 rows makes buffers of some 100 MB for each task out of
    documents of a few KB, in the executor and in its Python workers. A lower setting of the
    user's stays.
    """
    name, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
    return df
