"""Durable intermediate tables: they cut lineage, are read back as often as needed, and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master without it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp"))
    return _OWN[0]


def durable(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back."""
    path = f"{shared_folder(df.sparkSession)}/edgeframe-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes all tables that ``durable`` wrote in this process; their number. Results that still read them end with it."""
    count = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count
