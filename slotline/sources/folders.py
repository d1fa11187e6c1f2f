"""What lies in a folder of any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []
