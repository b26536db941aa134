"""Intermediate results in a folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path under ``spark.checkpoint.dir``, or under the warehouse where that is unset.

    Both are shared by all executors. What lies there goes when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop path and its file system, which know every store that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job of this library has written."""
    target, file_system = hadoop_path(spark, path)
    file_system.delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write once as Parquet and read back.

    Cuts the lineage: a lost executor costs a re-read of the staged files, never
    the shuffle that made them, and later passes read only the columns they use.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """The staged rows, for the time of a block that writes its own result."""
    path = scratch_dir(df.sparkSession)
    try:
        yield stage(df, path)
    finally:
        remove(df.sparkSession, path)
