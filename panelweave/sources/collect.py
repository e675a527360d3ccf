"""Collecting documents by key: what is still to be had, reading it with retries, and a table that is cache and log in one.

Every try leaves a row: key, status (ok, missing, failed), reason, attempts and, if ok, the bytes. A later run reads
from that table what is done, what may be tried again and how often it has been tried, so a run that was stopped resumes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import shared_folder

OK, MISSING, FAILED = "ok", "missing", "failed"
SCHEMA = "key string, status string, reason string, attempts int, payload binary"


def still_open(index: DataFrame, log: DataFrame, keys: Sequence[str], excluded: DataFrame | None = None, retry: Sequence[str] = (FAILED,), most: int = 3) -> DataFrame:
    """Rows of index to collect, with the attempts made so far: never tried, or of a status in `retry` and tried less than `most` times.

    log: keys, status, attempts (of one try; a null counts as one). A key that is ok once stays ok. Keys of `excluded` are left out.
    A null key is never collected.
    """
    again = F.min(F.col("status").isin([*retry]).cast("int")) == 1
    seen = log.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(again.alias("__again"), F.sum(F.coalesce("attempts", F.lit(1))).alias("__tried"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    rows = index.dropna(subset=[*keys]).join(seen, on, "left").where(F.col("__tried").isNull() | (F.col("__again") & (F.col("__tried") < most)))
    rows = rows.withColumn("attempts", F.coalesce("__tried", F.lit(0)).cast("int")).select(*index.columns, "attempts")
    return rows if excluded is None else rows.join(excluded.select(*keys).distinct(), [*keys], "left_anti")


class _Keys(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class FolderReader(DataSourceReader):
    """A partition per file of keys; a task reads the keys of its file and then their documents, a few MB at a time."""

    def __init__(self, options: dict) -> None:
        self.keys, self.folder, self.suffix = options["keys"], options["folder"].rstrip("/"), options.get("suffix", "")
        self.attempts, self.wait, self.batch = int(options.get("attempts", 3)), float(options.get("wait", 0.1)), int(options.get("batch_bytes", 4 << 20))

    def partitions(self) -> list[InputPartition]:
        store, at = fs.FileSystem.from_uri(self.keys)
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        return [_Keys(f.path) for f in found if f.is_file and f.base_name.startswith("part-")]

    def fetch(self, store: fs.FileSystem, path: str) -> tuple[str, str | None, int, bytes | None]:
        """status, reason, attempts, bytes. What isn't there is missing at once; other errors are tried again after a wait that doubles."""
        reason = None
        for attempt in range(1, self.attempts + 1):
            try:
                with store.open_input_file(path) as f:
                    return OK, None, attempt, f.read()
            except FileNotFoundError:
                return MISSING, "NOT_FOUND", attempt, None
            except OSError as e:
                reason = f"{type(e).__name__}: {e}"[:200]
                if attempt < self.attempts:
                    time.sleep(self.wait * 2 ** (attempt - 1))
        return FAILED, reason, self.attempts, None

    def read(self, partition: _Keys) -> Iterator[pa.RecordBatch]:
        keys_store, _ = fs.FileSystem.from_uri(self.keys)
        store, folder = fs.FileSystem.from_uri(self.folder)
        fields = pa.schema([("key", pa.string()), ("status", pa.string()), ("reason", pa.string()), ("attempts", pa.int32()), ("payload", pa.binary())])
        rows, held = [], 0
        with keys_store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["key"], batch_size=1000):
                for key in batch.column("key").to_pylist():
                    got = self.fetch(store, f"{folder}/{key}{self.suffix}")
                    rows.append((key, *got))
                    held += len(got[3] or b"")
                    if held >= self.batch or len(rows) >= 1000:
                        yield self._batch(rows, fields)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, fields)

    @staticmethod
    def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


class FolderSource(DataSource):
    """`spark.read.format("panelweave_folder")` with options keys (a Parquet folder with a column key), folder, suffix, attempts, wait."""

    @classmethod
    def name(cls) -> str:
        return "panelweave_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return FolderReader(dict(self.options))


def logged(spark: SparkSession, target: str) -> DataFrame:
    """The tries made so far, without their bytes; none where nothing has been collected."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(SCHEMA).parquet(target).select("key", "status", "reason", "attempts")
    return spark.createDataFrame([], "key string, status string, reason string, attempts int")


def collected(spark: SparkSession, target: str) -> DataFrame:
    """key, payload of what has been collected; of a key collected twice, one."""
    one = F.row_number().over(Window.partitionBy("key").orderBy("attempts"))
    return spark.read.schema(SCHEMA).parquet(target).where(F.col("status") == OK).withColumn("__k", one).where("__k = 1").select("key", "payload")


def collect(index: DataFrame, key: str, folder: str, target: str, suffix: str = "", excluded: DataFrame | None = None, retry: Sequence[str] = (FAILED,), most: int = 3, batch: int | None = None, tasks: int | None = None, attempts: int = 3, wait: float = 0.1) -> int:
    """Reads what of index (a column `key`) is still open, `batch` keys of it if given, and appends a row per key to target; how many keys there were.

    The rows are committed together, so a run that fails leaves what earlier runs have, and the next one goes on from there.
    """
    spark = index.sparkSession
    spark.dataSource.register(FolderSource)
    todo = still_open(index.select(F.col(key).cast("string").alias("key")).distinct(), logged(spark, target), ["key"], None if excluded is None else excluded.select(F.col(key).cast("string").alias("key")), retry, most)
    todo = todo.select("key") if batch is None else todo.select("key").orderBy("key").limit(batch)
    keys = f"{shared_folder(spark)}/panelweave-core/{uuid.uuid4().hex}/keys"
    todo.repartition(tasks or spark.sparkContext.defaultParallelism).write.parquet(keys)
    n = spark.read.parquet(keys).count()
    if n:
        options = {"keys": keys, "folder": folder, "suffix": suffix, "attempts": attempts, "wait": wait}
        spark.read.format(FolderSource.name()).options(**{k: str(v) for k, v in options.items()}).load().write.mode("append").parquet(target)
    return n


def read_companies(spark: SparkSession, path: str, row_tag: str = "list", fields: Sequence[str] = ("corp_code", "corp_name", "stock_code", "modify_date")) -> tuple[DataFrame, DataFrame]:
    """Companies of an XML list, all fields as stripped strings (leading zeros stay), and the entries that can't be read.

    A file is split between tasks at its row tags. An entry without a corp_code is one that can't be read.
    """
    schema = ", ".join(f"{f} string" for f in fields) + ", __bad string"
    options = {"rowTag": row_tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "ignoreSurroundingSpaces": "true", "nullValue": ""}
    rows = spark.read.format("xml").options(**options).schema(schema).load(path)
    stripped = rows.select(*(F.nullif(F.trim(f), F.lit("")).alias(f) for f in fields), "__bad")
    good = F.col("__bad").isNull() & F.col(fields[0]).isNotNull()
    return stripped.where(good).drop("__bad"), stripped.where(~good).withColumnRenamed("__bad", "entry")
