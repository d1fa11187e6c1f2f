"""Exact numbers over a whole table, without a window that holds it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.sources.scratch import kept

_INDEX = 33  # bits of monotonically_increasing_id that count the rows of a partition


def number_rows(rows: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """`rows` with numbers from 1 to n in `order`, as `row_number` over the whole table gives them.

    Rows are range-partitioned and sorted, which deals any number of different keys evenly.
    The sorted parts are kept in the shared folder together with each row's place in its
    part, so that the places don't change if a task runs again. What a part's first row has
    before it is a prefix sum of the parts' sizes, a row for each partition, which is
    broadcast. Ties are numbered in any order: name a key among the columns of `order`.
    An empty table stays empty.
    """
    spark = rows.sparkSession
    place = f"_{name}_place"
    parts = kept(rows.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "ordered")
    part, index = F.shiftright(place, _INDEX), F.col(place).bitwiseAND((1 << _INDEX) - 1)
    sizes = sorted(parts.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for s in sizes:
        offsets.append((s.part, before))
        before += s.n
    first = spark.createDataFrame(offsets, f"_{name}_part long, _{name}_before long")
    out = parts.join(F.broadcast(first), part == F.col(f"_{name}_part"))
    return out.select(*rows.columns, (F.col(f"_{name}_before") + index + 1).alias(name))
