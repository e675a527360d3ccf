"""Intermediate results as Parquet tables in a folder that driver and executors share: computed once, and not lost with an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one, gone with the process, where that is unset and all run in one process."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        own = tempfile.mkdtemp(prefix="panelweave-core-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[sc.applicationId] = f"file://{own}"
    return _OWN[sc.applicationId]


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table of their own, for what several parts of a plan read or what has to stay as it was drawn."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/panelweave-core/{uuid.uuid4().hex}/{name}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
