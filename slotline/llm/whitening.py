"""Embedding whitening with the covariance of distinct vectors.

Entries become whole numbers first, so that equal vectors are exactly equal. The distinct
ones are grouped once; each counts once, or as often as it occurs, in the mean and in the
covariance, which is a weighted matrix product of centred vectors, summed over tasks. Its
eigenvectors are the only thing that the driver works out, from a table of the size of the
dimension. Each distinct vector is projected once, and rows get the result by a join on the
vector's digest; digests that many rows share are broadcast.

Defined cases. Rows go whose vector is null, is empty, holds a null or a non-finite entry, or
one whose scaled value no long holds; also those whose length isn't the commonest one among
the distinct vectors (the larger of equally common). A null id and repeated rows stay. Only
components are returned whose eigenvalue isn't zero within rounding, so that a table of one
distinct vector has none. A deviation is exact at any size. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import left_join, stash, tidy

ROWS = 4096  # vectors of a matrix product
SCALE = 256


@dataclass(frozen=True)
class Fit:
    """What whitening needs: number of vectors (or their weight), sums, and the first components with their share of the variance."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray  # dimension x components
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def whole_vectors(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The id, the entries as longs (x) and the digest of x (key) of the rows whose vectors are whole."""
    v = F.col(vector).cast("array<double>")
    fine = lambda c: F.coalesce(F.abs(c * scale) < 2.0**63, F.lit(False)) & ~F.isnan(c)
    kept = rows.filter(F.coalesce(F.size(v) > 0, F.lit(False))).filter(F.forall(v, fine))
    x = kept.select(F.col(id_), F.transform(v, lambda c: F.floor(c * scale).cast("bigint")).alias("x"))
    text = F.array_join(F.transform("x", lambda c: c.cast("string")), ",")
    return x.withColumn("key", F.unhex(F.sha2(text, 256)))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """key, x and copies: a row for each distinct vector of the commonest length."""
    each = stash(rows.groupBy("key", "x").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    size = each.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1)
    first = size.first()
    return each.filter(F.size("x") == (first["size"] if first else 0))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for a in range(0, len(whole), ROWS):
            b = whole.slice(a, ROWS)
            yield b, b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)


def _total(parts: DataFrame, kind: str) -> dict[int, int | float]:
    return {r.cell: r.value for r in parts.groupBy("cell").agg(F.sum(F.col("value").cast(kind)).alias("value")).collect()}


def sums_of(vectors: DataFrame, weighted: bool) -> tuple[int, list[int]]:
    """Weight and exact sums of all dimensions; halves of 32 bits are summed, which no batch can overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _matrices(batches):
            w = b.column("copies").to_numpy() if weighted else np.ones(len(b), np.int64)
            hi, lo = x >> 32, x & 0xFFFFFFFF
            if weighted:  # Python's whole numbers, as a product may need more than 64 bits
                hi, lo, w = hi.astype(object), lo.astype(object), w.astype(object)
            values = [int(w.sum()), *(int(h) * (1 << 32) + int(l) for h, l in zip((hi * w[:, None]).sum(0), (lo * w[:, None]).sum(0), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values])], ["cell", "value"])

    got = _total(vectors.select("x", "copies").mapInArrow(tidy(run), "cell int, value string"), "decimal(38,0)")
    return int(got.get(0, 0)), [int(got[k]) for k in range(1, len(got))]


def covariance(vectors: DataFrame, n: int, sums: list[int], weighted: bool) -> np.ndarray:
    """The covariance about the mean, divisor n: a sum of products of centred vectors, each task's upper triangle added up by cell."""
    mean = np.array([s / n for s in sums])
    d = len(sums)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d)), False
        for b, x in _matrices(batches):
            centred = x - mean
            right = centred * b.column("copies").to_numpy()[:, None] if weighted else centred
            total += centred.T @ right
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], ["cell", "value"])

    got = _total(vectors.select("x", "copies").mapInArrow(tidy(run), "cell long, value double"), "double")
    out = np.zeros((d, d))
    out[upper] = [got[k] for k in range(len(upper[0]))]
    return (out + np.triu(out, 1).T) / n


def fit(vectors: DataFrame, components: int = 4, weighted: bool = False) -> Fit | None:
    """The components of `vectors` (distinct_vectors), None if there are no vectors. A component's largest entry is positive."""
    n, sums = sums_of(vectors, weighted)
    if not n:
        return None
    cov = covariance(vectors, n, sums, weighted)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    real = values > max(values[0], 0.0) * len(sums) * np.finfo(float).eps
    k = min(components, int(real.sum()))
    top = basis[:, :k]
    sign = np.sign(top[np.abs(top).argmax(0), np.arange(k)]) if k else np.ones(0)
    return Fit(n, tuple(sums), top * sign, values[:k].copy(), float(np.trace(cov)))


def whiten(vectors: DataFrame, model: Fit) -> DataFrame:
    """key, copies, the exact squared deviation from the mean times n squared, and the whitened components of each distinct vector."""
    mean, scaled, n = model.mean, model.vectors / np.sqrt(model.values), model.n
    largest = max(map(abs, model.sums))
    sums = np.array(model.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _matrices(batches):
            most = n * max(abs(int(x.max())), abs(int(x.min()))) + largest
            if most * most * x.shape[1] < 1 << 63:
                off = n * x - sums.astype(np.int64)
            else:
                off = n * x.astype(object) - sums
            deviation = pa.array([str(v) for v in (off * off).sum(1).tolist()])
            w = (x - mean) @ scaled
            flat = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), max(1, w.shape[1])) if w.shape[1] else pa.nulls(len(b), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), deviation, flat.cast(pa.list_(pa.float64()))], ["key", "copies", "deviation", "whitened"])

    out = vectors.select("key", "copies", "x").mapInArrow(tidy(run), "key binary, copies long, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(whitened: DataFrame, model: Fit, weighted: bool = False) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = model.vectors.shape[1]
    w = F.col("copies") if weighted else F.lit(1)
    at = [F.get("whitened", F.lit(i)) for i in range(k)]
    mean = whitened.agg(*[F.sum(a * w).alias(f"m{i}") for i, a in enumerate(at)]).first()
    centred = [a - mean[i] / model.n for i, a in enumerate(at)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = whitened.agg(*[F.sum(centred[i] * centred[j] * w).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v / model.n - (i == j)) for (i, j), v in zip(pairs, got, strict=True))


def whiten_rows(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = 4, weighted: bool = False, scale: int = SCALE) -> DataFrame:
    """For each whole vector's row and component: the id, component, n, deviation (decimal), whitened, explained, identity_error."""
    spark = rows.sparkSession
    whole = whole_vectors(rows, id_, vector, scale)
    vectors = distinct_vectors(whole)
    model = fit(vectors, components, weighted)
    kind = f"component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return whole.select(id_).limit(0).join(spark.createDataFrame([], kind), F.lit(False), "left").select(id_, *(f.split()[0] for f in kind.split(", ")))
    table = stash(whiten(vectors, model), "whitened")
    error = identity_error(table, model, weighted)
    total = table.agg(F.sum("copies")).first()[0]
    here = left_join(whole.select(id_, "key"), table, "key", "copies", total).filter(F.col("copies").isNotNull())
    explained = F.array(*[F.lit(float(v)) for v in model.explained])
    each = here.select(id_, "deviation", F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("place", "one"))
    return each.select(
        id_, (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("one.whitened").alias("whitened"), F.col("one.explained").alias("explained"), F.lit(error).alias("identity_error"),
    )
