"""Shared plumbing: tables, shared-folder materialisation, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one of our own in local mode.

    A cluster session without the setting is refused: a machine-local folder there loses data.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file:/tmp/quillspark-shared/{spark.sparkContext.applicationId}"
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Written intermediate tables in the shared folder; they cut lineage and survive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        at = self.path(label)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df: DataFrame) -> None:
        """Delete a table from write() that nothing reads any more."""
        for file in df.inputFiles()[:1]:
            self.delete(file.rsplit("/", 1)[0])

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_KEPT: dict[tuple, object] = {}


def kept(kind, path: str, **options):
    """One object, such as a tokenizer with its memo, for each worker process, until release()."""
    key = (kind, path, *sorted(options.items()))
    if key not in _KEPT:
        _KEPT[key] = kind(path, **options)
    return _KEPT[key]


def release() -> None:
    """Give a worker's memory back before other work: what is kept, Arrow's unused buffers, and what malloc holds free."""
    _KEPT.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the machine; workers live on and would hold it beside the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def strings(array: pa.Array) -> list[str]:
    """Python strings; null becomes empty, invalid UTF-8 is replaced."""
    try:
        return [x or "" for x in array.to_pylist()]
    except UnicodeDecodeError:
        raw = array.cast(pa.binary() if not pa.types.is_large_string(array.type) else pa.large_binary())
        return [(x or b"").decode("utf-8", "replace") for x in raw.to_pylist()]


def slices_by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of the column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def code_points(col: Column) -> Column:
    return F.length(col).cast("long")


def unused(name: str, taken: list[str]) -> str:
    """The name, with as many leading underscores as it takes to differ from all taken ones, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def text_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads; extra columns, whatever their names, stay behind."""
    return df.select(F.col(key), F.col(text))
