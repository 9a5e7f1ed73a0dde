"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table of splits, nodes or cells up to which it is broadcast.
MOST_BROADCAST = 1 << 16


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode, where there is one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_vicinal_scratch"):
        spark._vicinal_scratch = tempfile.mkdtemp(prefix="vicinal-")
    return spark._vicinal_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there stays until release, or until the driver ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not hasattr(spark, "_vicinal_tables"):
        spark._vicinal_tables = []
        atexit.register(_release_at_exit, spark)
    spark._vicinal_tables.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a scratch path and reads it back: plans stay short, and what is lost with an executor is read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes what scratch paths hold, but for the first `since` ones, and returns their number. DataFrames that read them end with that: call it when their results have been taken."""
    tables = getattr(spark, "_vicinal_tables", [])
    gone = tables[since:]
    for path in gone:
        delete_path(spark, path)
    del tables[since:]
    return len(gone)


def _release_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        release(spark)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written within, for work whose results are stored by its end."""
    before = len(getattr(spark, "_vicinal_tables", []))
    try:
        yield
    finally:
        release(spark, before)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
