"""Intermediate tables in the folder that all executors share. What a session wrote is dropped when its Python process ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _drop(spark: SparkSession, path: str) -> None:
    """Best effort at the end of a process: a session that has stopped can't reach its folders."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001
        pass


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor sees: below spark.checkpoint.dir, or a local one where that is unset and all tasks are local, too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def store(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """materialize(df), and a call that drops its folder: for loops, once nothing reads a round any more."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: _drop(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back, so that a lost executor costs no recomputation."""
    return store(df)[0]
