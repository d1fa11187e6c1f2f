"""Importance resampling towards a target distribution of hashed n-grams.

Runs of one to `order` words are hashed into buckets. A bucket's gain is the logarithm of
how much commoner it is in the target than in the corpus, both smoothed; a document's weight
is the mean gain of its features. Gumbel noise, a function of the document's id and the seed
alone, makes the highest scores a draw without replacement by the weights.

In a task the n-grams of a block of texts are interned by an open-addressed table
(`ngram_table`): a bucket and a count for each slot, and for each occurrence its slot, by
which gains are gathered. Counts of buckets are summed by a grouped aggregation, numbers of
the draw by range partitioning (`number_rows`): no task holds more than its share, and the
driver a number for each bucket.

Defined cases. Null texts are empty; a text without words has no feature, weight 0 and a
score, and isn't drawn. Repeated rows count as often as they occur and are drawn each for
itself. A null doc_id is hashed as the empty text and goes last among equal scores. Without
a target all gains are those of an empty one. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import stash, tidy
from slotline.llm.ngram_table import tables
from slotline.operators.ordering import number_rows


@dataclass(frozen=True)
class Plan:
    order: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def bucket_counts(rows: DataFrame, plan: Plan = Plan()) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(plan.buckets, np.int64)
        for b in batches:
            for _, _, t, _, _ in tables(b.column(0), plan.order, plan.buckets):
                np.add.at(total, t.bucket[t.used], t.count[t.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    text = rows.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("text <> ''")
    out = np.zeros(plan.buckets, np.int64)
    for r in text.mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed shares in the target and in the corpus, floored."""
    k = len(source)
    s_all, t_all = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_words, n_features and the floored mean gain of each row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, features, total = (np.zeros(len(b), np.int64) for _ in range(3))
            for first, last, t, text, n_words in tables(b.column("text"), plan.order, plan.buckets):
                words[first:last] += n_words
                features[first:last] += np.bincount(text, minlength=last - first)
                by_slot = gain[t.bucket]
                np.add.at(total, first + text, by_slot[t.slot])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(words), pa.array(features), pa.array(np.where(features > 0, total // np.maximum(features, 1), 0))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> F.Column:
    """A thousand times Gumbel noise of the document's id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is the place in the draw, null if it isn't drawn.

    Of the rows with at least `least_words` words, `percent` in a hundred are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs, plan), bucket_counts(target, plan))
    scored = stash(weigh(docs, gain, plan).withColumn("score", F.col("weight") + noise(plan.seed)), "scored")
    able = F.col("n_words") >= plan.least_words
    drawn = scored.filter(able).count() * plan.percent // 100
    out = ("doc_id", "n_features", "weight", "score")
    ranked = number_rows(scored.filter(able).select(*out), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~able).select(*out, F.lit(None).cast("long").alias("rank")))
