"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.sources.scratch import new_path, remove

SPACE = r"[\x20\x09-\x0D]+"


class Scratch:
    """Tables written to one folder of the shared one, which cuts their lineage; `drop` removes them all."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, new_path(spark, name)
        self.tables = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.path)
        give_back()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back; it stays, as a result may be read at any time."""
    return Scratch(df.sparkSession, name).put(df, "table")


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on a batch of rows for Python holds about so many bytes at most, however long the rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def give_back() -> None:
    """Give memory that this process has, and doesn't use, back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """`run` for mapInArrow, after which its worker, which stays for other tasks, gives unused memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text with null as empty, and the columns asked for; all others go."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_share(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """About `most` of the rows, those whose hashed keys are in a share of that size; all if there are no more.

    Name a text or the like among the keys, so that rows of one identifier, or without any, are shared out as well.
    """
    total = rows.count()
    if total <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*keys, F.lit("share")), F.lit(1 << 40)) < int(most / total * (1 << 40)))


def left_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, most: int = 1000) -> DataFrame:
    """`rows` with the columns of `table`, which has a row for each key and says in `weight` how many rows have it.

    Keys that a `most`-th of all rows or more have are `most` at most and are broadcast; rows
    without a key aren't shuffled.
    """
    often = F.col(weight) * most >= max(1, total)
    hot, cold = F.broadcast(table.filter(often)), table.filter(~often)
    here = rows.join(hot, key, "left")
    here = here.filter(F.col(key).isNull() | F.col(weight).isNotNull())
    return here.unionByName(rows.filter(F.col(key).isNotNull()).join(hot, key, "left_anti").join(cold, key, "left"))


def free(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"
