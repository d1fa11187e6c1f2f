"""The bookings log: a CSV file with a header, read by name, all columns strings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("created_utc", "name", "email", "slot_label", "slot_local_start", "slot_local_end", "message", "event_link", "meet_link")
LATE_COLUMNS = ("status", "confirmed_utc", "email_sent_utc")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS + LATE_COLUMNS])


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One header version of the log, each file read by one task (`split_csv.scan` reads them in parts). A missing path or an empty file gives no rows.

    Columns are taken by name, late ones may be absent or in any order, short rows are kept.
    """
    try:
        raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], SCHEMA)
    have = set(raw.columns)
    return raw.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast("string").alias(c) for c in SCHEMA.names])


def scan_versions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several header versions, each read with its own header."""
    out = scan(spark, paths[0])
    for path in paths[1:]:
        out = out.unionByName(scan(spark, path))
    return out


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows with a header; quotes are doubled and line ends kept."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue=None)


def append_parquet(df: DataFrame, path: str) -> None:
    """The typed log: appended to, in a folder for each day of intake.

    Rows are rebalanced by day first: a day's rows are in as many files as their size needs,
    not in one for each task, and a hot day is split.
    """
    df.withColumn("intake_date", F.to_date("created_utc")).hint("rebalance", "intake_date").write.mode("append").partitionBy("intake_date").parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What `append_parquet` has put in a log of this schema, with the day of intake; a log to which only empty tables were appended is empty."""
    return spark.read.schema(T.StructType([*schema, T.StructField("intake_date", T.DateType())])).parquet(path)


def rewrite_parquet(versions: list[DataFrame], path: str) -> None:
    """Rows of several header versions in a new folder, with all their columns in the order first seen."""
    out = versions[0]
    for rows in versions[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    out.write.parquet(path)


def truncate_parquet(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """An empty, typed log."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
