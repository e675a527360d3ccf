"""Token ids in ORC: integer run-length encoding, stripes, row indexes and Bloom filters on the document id.

Documents are dealt by ranges of their id and sorted within each range, so the files, in the order
of their numbers, hold all documents in ascending order, and a stripe holds neighbours. The ORC
writer gives the ids run-length encoded integers, keeps the least and greatest document id of each
file, stripe and row group, and a Bloom filter per row group; a lookup by document id skips what
these rule out, and a scan reads stripes in parallel.

Defined results: a null or empty text has the end id alone; a null id comes first; rows that share
an id stay next to each other, in any order; other columns aren't stored; an empty table gives an
empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import bound_batches

#: Rows per entry of the row index; each entry has a Bloom filter.
STRIDE = 1000


def write(docs: DataFrame, path: str, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID, stripe_bytes: int = 16 << 20, false_positives: float = 0.01) -> None:
    """Writes row_no, doc_id, n_tokens and ids of each document, in ascending doc_id order."""
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = spark.sparkContext.broadcast(tokens.read_vocabulary(vocabulary_path))
    id_type = docs.schema[id_col].dataType

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in tokens.encoded(batches, vocabulary, "text", end_id):
            lengths = np.array([len(x) for x in ids], dtype=np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("doc_id"), pa.array(lengths), pa.ListArray.from_arrays(starts, flat)], names=["row_no", "doc_id", "n_tokens", "ids"])

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered = ordered.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    out = ordered.mapInArrow(encode, f"row_no bigint, doc_id {id_type.simpleString()}, n_tokens int, ids array<int>")
    options = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": STRIDE, "orc.stripe.size": stripe_bytes, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": false_positives, "orc.compression.zstd.level": 1}
    out.write.options(**options).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The stored rows, or those of these documents: the filter reaches the files' indexes and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def checksums(rows: DataFrame) -> DataFrame:
    """row_no, doc_id, n_tokens and ids_crc32 of stored rows, from the ids themselves."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            starts = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype(tokens.ID)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("doc_id"), pa.array(np.diff(starts).astype(np.int64)), pa.array(sums, pa.int64())], names=["row_no", "doc_id", "n_tokens", "ids_crc32"])

    return rows.select("row_no", "doc_id", "ids").mapInArrow(crc, f"row_no bigint, doc_id {id_type}, n_tokens bigint, ids_crc32 bigint")


def with_starts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds start: the ids of all rows before a row. rows: row_no and n_tokens; stored: the store, whose ids aren't read for this.

    row_no counts within a file from file << 33, so each file is summed by itself, and only one
    number per file meets in one task.
    """
    rows = rows.withColumn("file_no", F.shiftright("row_no", 33))
    files = stored.groupBy(F.shiftright("row_no", 33).alias("file_no")).agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("file_no").alias("of_file"), before.alias("files_before"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(files, F.col("file_no") == F.col("of_file")).withColumn("start", (F.col("files_before") + own).cast("bigint")).drop("of_file", "file_no", "files_before")
