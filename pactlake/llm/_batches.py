"""Shared helpers for operators that walk whole texts in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that numpy code expands at once; longer single texts form a slice of their own.
SLICE_BYTES = 2 << 20


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy row ranges of a batch, each of about ``limit`` bytes of text or one row."""
    lengths = batch.column(text).cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(lengths.buffers()[1], np.int64, len(lengths) + 1, lengths.offset * 8) if len(lengths) else [0]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class TwoGenerationCache:
    """A bounded memo: at ``limit`` entries the young generation becomes the old one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def recall(self, key):
        """Moves one key of the old generation to the young one; its value, or None."""
        if (value := self.old.get(key)) is not None:
            self.young[key] = value
        return value

    def settle(self, keys: set) -> list:
        """Moves known keys to the young generation and returns those that are unknown."""
        if len(self.young) + len(keys) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        unknown = []
        for key in keys.difference(young):
            if (value := old.get(key)) is None:
                unknown.append(key)
            else:
                young[key] = value
        return unknown


#: Rows of an Arrow batch, where the session has Spark's default: long texts have to fit.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch unless the session has a value of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that numpy and Arrow have freed back to the system; workers outlive tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` or the context's own.

    Where neither is set, a run within one machine gets a temporary folder; a cluster gets an error,
    as its executors would not see such a folder.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if (held := sc._jsc.sc().getCheckpointDir()).isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="pactlake-checkpoint-")
        sc.setCheckpointDir(where)
        return sc._jsc.sc().getCheckpointDir().get()
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and cuts its lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written below the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
