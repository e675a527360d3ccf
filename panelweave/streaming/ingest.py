"""Incremental ingestion: what is new since the last run, exactly once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType | str, keys: Sequence[str], transform: Callable[[DataFrame], DataFrame] = lambda x: x, kind: str = "parquet") -> StreamingQuery:
    """Appends the transformed rows of new files whose keys the target doesn't hold; ends when all files are read.

    The checkpoint remembers files, the anti-join remembers keys; a batch that is repeated after a failure adds nothing twice.
    """

    def land(batch: DataFrame, _: int) -> None:
        fresh = transform(batch).dropDuplicates([*keys])
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(path):
            done = batch.sparkSession.read.parquet(target).select(*keys)
            fresh = fresh.join(done, [*keys], "left_anti")
        fresh.write.mode("append").parquet(target)

    stream = spark.readStream.format(kind).schema(schema).load(source)
    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
