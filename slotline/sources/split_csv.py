"""A CSV log read in parts, though its fields may hold line ends.

A line begins a record if an even number of quotes stands before it in its file; a quote
within a field is doubled and doesn't change that. So each part of a file reports the
parity of its quotes, a prefix sum over the parts of a file says in which of them the first
line begins inside a field, and then every part finds its own records. What a record has on
both sides of a cut is put together from the pieces of two parts or more, which are few.

Files are read in parts of `spark.sql.files.maxPartitionBytes`, so that no file is a task. All
files of a folder are scanned together, whatever their headers: the first line of each is
found along with the parities, and a column is taken from where its file's header has it.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotline.sources.bookings_csv import SCHEMA
from slotline.sources.scratch import kept

if TYPE_CHECKING:
    import pyarrow as pa

HEADERS = 1000  # different ones in a folder at most
RECORD = "header int, file long, block long, kind int, text string"
WHOLE, HEAD, TAIL = 0, 1, 2  # a record; what ends one that a part before began; what begins one that a later part ends


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line with its file's hash and where its part of the file begins; a part's lines come in order."""
    rows = spark.read.text(path, lineSep="\n")
    return rows.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def edges(lines: DataFrame) -> DataFrame:
    """file, block, odd (whether the part begins inside a field) and first (the first line of the file): a row for each part."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    rows = lines.select("file", "block", quotes.alias("quotes"), F.when(F.col("block") == 0, F.col("value")).alias("value"), F.monotonically_increasing_id().alias("place"))
    parts = rows.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("parity"), F.min_by("value", "place").alias("first"))
    file = Window.partitionBy("file")  # a row for each part of one file
    before = F.coalesce(F.sum("parity").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("file", "block", (before % 2 == 1).alias("odd"), F.max("first").over(file).alias("first"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RECORD of lines (value, file, block, odd, header)."""
    import numpy as np  # here, as only this scan needs them
    import pyarrow as pa
    import pyarrow.compute as pc

    out: list[tuple] = []
    part, inside, open_, begun = None, False, [], False

    def ended() -> None:
        """The part is over: what is open is a record, or a piece of one that goes on."""
        if open_:
            kind = HEAD if not begun else TAIL if inside else WHOLE
            out.append((*part, kind, "\n".join(open_)))

    def rows() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], [f.split()[0] for f in RECORD.split(", ")])
        out.clear()
        return batch

    for b in batches:
        quotes = pc.count_substring(b.column("value"), '"').to_numpy(zero_copy_only=False)
        file, block = (b.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block"))
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(b)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            here = (b.column("header")[x].as_py(), int(file[x]), int(block[x]))
            if here != part:
                ended()
                part, inside, open_, begun = here, b.column("odd")[x].as_py(), [], False
            upto = np.cumsum(quotes[x:y]) + inside
            starts = np.concatenate([[inside], upto[:-1] % 2 == 1]) == 0
            for line, begins in zip(b.column("value").slice(x, y - x).to_pylist(), starts.tolist(), strict=True):
                if begins:
                    if open_:
                        out.append((*part, WHOLE if begun else HEAD, "\n".join(open_)))
                    open_, begun = [line], True
                else:
                    open_.append(line)
            inside = bool(upto[-1] % 2)
        if len(out) >= 5000:
            yield rows()
    ended()
    if out:
        yield rows()


def _joined(pieces: DataFrame) -> DataFrame:
    """Records (header, file, block, text) of pieces: a tail and all heads up to the next tail of its file."""
    w = Window.partitionBy("file").orderBy("block", "kind")  # a file's pieces: two for each of its parts at most
    rows = pieces.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    return rows.groupBy("header", "file", "record").agg(F.min("block").alias("block"), F.array_join(F.transform(parts, lambda p: p.text), "\n").alias("text")).drop("record")


def records(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[str]]]:
    """The records of all files (header: the place of its file's header in the list; text: as it stands) and the different headers."""
    lines = _lines(spark, path)
    found = kept(edges(lines), "csv-edges")
    headers = [r.first for r in found.select("first").distinct().orderBy("first").limit(HEADERS + 1).collect()]
    if len(headers) > HEADERS:
        raise ValueError(f"more than {HEADERS} different headers in {path}")
    number = F.array_position(F.array(*[F.lit(h) for h in headers]) if headers else F.array().cast("array<string>"), F.col("first")) - 1
    # a row for each part of a file, under a hundred bytes: 100 TB in parts of 128 MB are under 80 MB
    known = F.broadcast(found.select("file", "block", "odd", number.cast("int").alias("header")))
    there = lines.join(known, ["file", "block"], "left")
    odd = F.when(F.col("header").isNull(), F.raise_error(F.lit("the parts of the files have changed since they were looked at"))).otherwise(F.col("odd"))
    got = there.select("value", "file", "block", odd.cast("boolean").alias("odd"), "header").mapInArrow(_records, RECORD)
    whole = got.filter(F.col("kind") == WHOLE).select("header", "file", "block", "text")
    return whole.unionByName(_joined(got.filter(F.col("kind") != WHOLE))), [_fields(h) for h in headers]


def _fields(header: str | None) -> list[str]:
    return next(csv.reader([(header or "").removesuffix("\r").removeprefix("﻿")]), [])


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All bookings of a file or folder, by name, as `bookings_csv.scan` reads each file; a missing path or empty files give no rows.

    Columns that a header lacks are null, short rows are kept, blank lines and repeated
    headers go. A header holds no line end; lines end in \\n or \\r\\n, and those within a field stay
    as they are.
    """
    try:
        rows, headers = records(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    width = max([1, *map(len, headers)])
    text = F.regexp_replace("text", "\r$", "")
    body = rows.filter(text != "").withColumn("text", text)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    parsed = body.select("header", "block", F.from_csv("text", ", ".join(f"c{k} string" for k in range(width)), options).alias("v"))
    first = F.lit(False)
    for h, names in enumerate(headers):
        first = first | ((F.col("header") == h) & (F.col("block") == 0) & F.forall(F.array(*[F.struct(F.col(f"v.c{k}").alias("x"), F.lit(n).alias("n")) for k, n in enumerate(names)]), lambda p: p.x.eqNullSafe(p.n)) if names else F.lit(False))
    out = parsed.filter(~first)

    def column(name: str) -> F.Column:
        value = F.lit(None).cast("string")
        for h, names in enumerate(headers):
            if name in names:
                value = F.when(F.col("header") == h, F.col(f"v.c{names.index(name)}")).otherwise(value)
        return value.alias(name)

    return out.select(*map(column, SCHEMA.names))
