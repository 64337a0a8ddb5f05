"""Shared scratch space: tables that cut lineage live where every executor can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Rows that a task of ``spread`` gets, so that its memory doesn't grow with the input.
ROWS = 250_000


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set and driver and executors are one process.

    On a cluster without that setting this raises: executors could not read each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="trustweave-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt out by ``keys`` in as many parts as its rows ask for (``rows``; counted if not given), for windows, groups and joins by these keys or more.

    Parts that Spark sizes by their shuffled bytes are up to sixteen times as large in memory.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)), *keys)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that nothing reads any more, in whatever store they are; those that aren't there are passed over."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
