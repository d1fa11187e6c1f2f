"""A table of keyed rows of which each version holds the changed ones only.

`version=<epoch>` folders hold the rows that changed in an epoch, `base=<epoch>` folders all
rows as of an epoch. The table's rows are the latest of each key. A version that is written
again replaces itself, so that an epoch may be repeated after a crash; a base counts once it
is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.sources.folders import children
from slotline.sources.scratch import remove


def put_version(rows: DataFrame, path: str, epoch: int) -> None:
    """The rows that changed in an epoch: one for each key at most."""
    rows.write.mode("overwrite").parquet(f"{path}/version={epoch:012d}")


def _epochs(spark: SparkSession, path: str, kind: str) -> list[int]:
    found = [n for n in children(spark, path) if n.startswith(f"{kind}=")]
    return sorted(int(n.partition("=")[2]) for n in found if "_SUCCESS" in children(spark, f"{path}/{n}"))


def latest(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The latest row of each key; no rows if nothing was put. Null keys are one key.

    Only newer versions are grouped; of the base those rows are read whose key none of them has.
    """
    base, names = _epochs(spark, path, "base")[-1:], [f.split()[0] for f in schema.split(",")]
    newer = [e for e in _epochs(spark, path, "version") if not base or e > base[0]]
    old = spark.read.schema(schema).parquet(f"{path}/base={base[0]:012d}") if base else spark.createDataFrame([], schema)
    if not newer:
        return old
    rows = spark.read.schema(f"{schema}, version long").option("basePath", path).parquet(*[f"{path}/version={e:012d}" for e in newer])
    new = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), "version").alias("_row")).select("_row.*")
    if not base:
        return new
    changed = new.select(F.col(key).alias("_changed"))
    return old.join(changed, F.col(key).eqNullSafe(F.col("_changed")), "left_anti").unionByName(new)


def compact(spark: SparkSession, path: str, key: str, schema: str, clear: bool = True) -> int | None:
    """Write a base of all rows as of the last version, and then drop what it replaces; a reader of older rows has to be done by then.

    Returns the base's epoch, None if there is no version newer than the last base.
    """
    bases, versions = _epochs(spark, path, "base"), _epochs(spark, path, "version")
    if not versions or bases and versions[-1] <= bases[-1]:
        return None
    epoch = versions[-1]
    latest(spark, path, key, schema).write.mode("overwrite").parquet(f"{path}/base={epoch:012d}")
    for kind, old in (("base", bases), ("version", versions)) if clear else ():
        for e in old:
            remove(spark, f"{path}/{kind}={e:012d}")
    return epoch
