"""Paths for intermediate data, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}  # by application


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="slotline-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local master may go without."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `release` removes."""
    path = f"{shared_dir(spark)}/slotline/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def release(spark: SparkSession) -> int:
    """Remove all that this application has put in the shared folder; results that weren't saved can't be read any more.

    Returns how many paths that were.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)
