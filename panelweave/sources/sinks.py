"""Sinks: overwrite, append, one JSON per document, and stop-word tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV files with a header; mark: each begins with a byte order mark, which spreadsheets ask for."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def append(df: DataFrame, path: str) -> None:
    """New part files; what is there isn't read or rewritten."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, without: tuple[str, ...] = ()) -> None:
    """All or nothing: readers see the old table until the new one is committed."""
    df.drop(*without).write.mode("overwrite").parquet(path)


def to_json(df: DataFrame, path: str, key: str) -> None:
    """A folder per key with its document as JSON."""
    df.select(F.col(key).alias("__key"), F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").partitionBy("__key").text(path)
