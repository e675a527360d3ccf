"""What the operators share: the scratch folder, written tables and Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN = threading.local()
#: What a worker keeps from task to task.
KEPT: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset and all run in one process."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="panelweave-")
        sc.setCheckpointDir(_OWN[sc.applicationId])
    return _OWN[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/panelweave/{uuid.uuid4().hex}/{name}"
    _written(spark).append(path)
    return path


def _written(spark: SparkSession) -> list[str]:
    """Scratch paths that this thread has made in this application."""
    return _WRITTEN.__dict__.setdefault(spark.sparkContext.applicationId, [])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and lost executors don't lose it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table made by materialize(); nothing may read it later."""
    spark = df.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/panelweave/" in path:
            drop_path(spark, path)


@contextmanager
def recorded(spark: SparkSession, into: list[str]) -> Iterator[None]:
    """Adds the scratch paths made meanwhile to a list, for a caller that knows when nothing reads them any more."""
    made = _written(spark)
    n = len(made)
    try:
        yield
    finally:
        into.extend(made[n:])


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Arrow batches of fewer rows and bytes, where the session has the defaults of 10,000 and 64 MB: long texts, or parts of filters
    that tasks send, would make batches of that size, which executors hold twice and workers again."""
    for key, default, most in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", f"{size}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 of each value, b"" for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return (x or b"" for x in column.cast(pa.large_binary()).to_pylist())


def small_batches(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about `limit` bytes and one row at least, so that very long texts don't add up.

    What other tasks have left in KEPT goes, but for `keeps`: else workers would carry an earlier operator's tables through all later ones.
    """
    for name in KEPT.keys() - {keeps}:
        del KEPT[name]
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release_memory()


def release_memory() -> None:
    """What a task has freed goes back to the system: idle workers stay for later tasks, and stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
