"""Mixing to target weights with soft domain membership, in DataFrame functions only.

A text's domains are those of the label table: good or bad quality, each toxic or not. A
naive Bayes classifier over hashed words and the share of different words predicts their
posteriors p_dk for every text d. With t_d words, the expected words of domain k under
document rates w_d >= 0 are sum_d w_d t_d p_dk. Projected gradient descent on the squared
distance to the target totals fits the rates. It works on w_d sqrt(t_d), so that a change
costs a text by its words and long texts aren't changed first, and measures the distance
by the inverse Gram matrix of the sqrt(t_d) p_dk, for which the step is 1: a step takes
p_d G^-1 (totals - targets) from w_d. Steps gather momentum, which starts anew whenever the
distance grows. An iteration is one distributed sum of K numbers; rates are a function of a
row's K numbers, its rate and momentum so far and the K-vectors of the last steps. Every
KEPT steps the rows are written with their rates, so that no step is computed more often
than that.

The target total is the largest that lets the domain with the most words keep them, unless
one is given. Rates start at 1.

Bounds of the training sample (the only sample here): about TRAIN_DOCS labelled doc_ids, a
share of all by hashed id, and no more than twice as many. All else covers all texts.

Defined cases. A null, empty or blank text has no words and keeps rate 1, as it can't change
any total. Null labels don't count; a doc_id labelled repeatedly counts once, by its smallest
labels. Without labelled texts all is in the first domain. Null doc_ids stay null; repeated
rows are mixed each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import SPACE, Scratch, free, hashed_share, stash, texts

DOMAINS = ("good", "good_toxic", "bad", "bad_toxic")
#: The shares of words asked for in production.
TARGETS = {"good": 0.9, "good_toxic": 0.04, "bad": 0.05, "bad_toxic": 0.01}
TRAIN_DOCS = 4000
BUCKETS, SHAPES = 4096, 16
EFFECTIVE_WORDS = 60.0
ITERATIONS, TOLERANCE, KEPT = 40, 1e-6, 8


@dataclass
class Model:
    prior: np.ndarray  # log P(domain)
    words: np.ndarray  # K x BUCKETS, log P(bucket | domain)
    shape: np.ndarray  # K x SHAPES, log P(share of different words | domain)


def with_words(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text's word buckets, how many words it has, and the class of its share of different words."""
    words = F.filter(F.split("text", SPACE), lambda x: x != "")
    rows = texts(docs, *more).select("doc_id", *more, F.xxhash64("text").alias("mark"), words.alias("words"))
    share = F.size(F.array_distinct("words")) / F.greatest(F.size("words"), F.lit(1))
    return rows.select(
        "doc_id", *more, "mark",
        F.transform("words", lambda x: F.pmod(F.hash(x), F.lit(BUCKETS))).alias("buckets"),
        F.size("words").cast("long").alias("tokens"),
        F.least(F.floor(share * SHAPES), F.lit(SHAPES - 1)).cast("int").alias("shape"),
    )


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 1, F.lit(0)).otherwise(F.lit(2)) + F.when(toxic == 1, F.lit(1)).otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Smoothed counts of the labelled sample; they come to K x (BUCKETS + SHAPES + 1) numbers at most."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    chosen = hashed_share(known, train_docs, "doc_id").orderBy(F.xxhash64("doc_id")).limit(2 * train_docs)
    chosen = chosen.select(F.col("doc_id").alias("labelled"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_words(rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "domain"), "domain")
    parts = F.concat(F.transform("buckets", lambda b: F.struct(F.lit("word").alias("kind"), b.alias("place"))), F.array(F.struct(F.lit("shape").alias("kind"), F.col("shape").alias("place"))))
    counts = rows.select("domain", F.explode(parts).alias("x")).groupBy("domain", "x.kind", "x.place").count().collect()
    k = len(DOMAINS)
    words, shape = np.full((k, BUCKETS), 0.05), np.full((k, SHAPES), 0.5)
    size = np.ones(k)
    for r in counts:
        if r.kind == "word":
            words[r.domain, r.place] += r["count"]
        else:
            shape[r.domain, r.place] += r["count"]
            size[r.domain] += r["count"]
    if not counts:
        size[0] += 1e9
    return Model(np.log(size / size.sum()), np.log(words / words.sum(axis=1, keepdims=True)), np.log(shape / shape.sum(axis=1, keepdims=True)))


def posteriors(rows: DataFrame, model: Model) -> list[Column]:
    """P(domain | text) for rows of `with_words`; words count as EFFECTIVE_WORDS at most."""
    damp = F.least(F.lit(1.0), F.lit(EFFECTIVE_WORDS) / F.greatest(F.col("tokens"), F.lit(1)))

    def against_first(k: int) -> Column:
        table = F.lit(model.words[k] - model.words[0])
        words = F.aggregate("buckets", F.lit(0.0), lambda s, b: s + F.get(table, b))
        return words * damp + F.get(F.lit(model.shape[k] - model.shape[0]), F.col("shape")) + float(model.prior[k] - model.prior[0])

    return [F.lit(0.0), *(F.least(F.lit(60.0), F.greatest(F.lit(-60.0), against_first(k))) for k in range(1, len(DOMAINS)))]


def memberships(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), tokens and p_<domain> for every text."""
    rows = with_words(docs)
    logs = posteriors(rows, fit(docs, labels))
    rows = rows.select("doc_id", "mark", "tokens", F.array(*logs).alias("logs"))
    most = F.array_max("logs")
    rows = rows.withColumn("parts", F.transform("logs", lambda x: F.exp(x - most)))
    total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", "mark", "tokens", *((F.col("parts")[k] / total).alias(f"p_{d}") for k, d in enumerate(DOMAINS)))


@dataclass
class Step:
    move: np.ndarray  # what a unit of each domain takes from a rate
    momentum: float


def rate(steps: list[Step], highest: float | None = None, ahead: bool = False) -> Column:
    """A row's rate after the given steps, from its columns w and y on; `ahead`: where its momentum takes it, for the next step's totals."""
    if not steps:
        return F.col("y" if ahead else "w")
    moves = [F.lit(np.array([s.move[k] for s in steps])) for k in range(len(DOMAINS))]
    momentum = F.lit(np.array([s.momentum for s in steps]))

    def step(x: Column, j: Column) -> Column:
        to = x.y - sum((F.col(f"p_{d}") * F.get(moves[k], j) for k, d in enumerate(DOMAINS)), F.lit(0.0))
        w = F.greatest(F.lit(0.0), to if highest is None else F.least(to, F.lit(highest)))
        return F.struct(w.alias("w"), (w + F.get(momentum, j) * (w - x.w)).alias("y"))

    start = F.struct("w", "y")
    last = F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), start, step)
    return F.when(F.col("tokens") > 0, last.y if ahead else last.w).otherwise(F.lit(1.0))


def fit_rates(members: DataFrame, targets: dict[str, float], total: float | None = None, highest: float | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """`members` with their rates w after projected gradient descent, which goes on from 1."""
    members, scratch = members.withColumns({"w": F.lit(1.0), "y": F.lit(1.0)}), None
    own = [F.col("tokens") * F.col(f"p_{d}") for d in DOMAINS]
    k = len(DOMAINS)
    sums = members.agg(*[F.sum(own[i]).alias(f"s{i}") for i in range(k)], *[F.sum(own[i] * F.col(f"p_{DOMAINS[j]}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    natural = np.array([sums[f"s{i}"] or 0.0 for i in range(k)])
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    weight = np.array([targets[d] for d in DOMAINS], float) / sum(targets.values())
    biggest = int(natural.argmax())
    goal = weight * (total if total is not None else natural[biggest] / max(weight[biggest], 1e-9))
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    steps: list[Step] = []
    speed, before = 1.0, np.inf
    for _ in range(iterations):
        w = rate(steps, highest, ahead=True)
        got = natural if before == np.inf else np.array(members.agg(*[F.sum(w * x) for x in own]).first(), float)
        off = got - goal
        distance = float(off @ inverse @ off)
        if np.abs(off).sum() <= TOLERANCE * max(goal.sum(), 1.0):
            break
        if distance > before:
            speed = 1.0
        after = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        steps.append(Step(inverse @ off, (speed - 1) / after))
        speed, before = after, distance
        if len(steps) == KEPT:
            written = Scratch(members.sparkSession, "rates")
            members = written.put(members.withColumns({"w": rate(steps, highest), "y": rate(steps, highest, ahead=True)}), "members")
            if scratch:
                scratch.drop()
            scratch, steps = written, []
    return members.withColumn("w", rate(steps, highest)).drop("y")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, highest: float | None = None) -> DataFrame:
    """doc_id, mark, tokens, p_<domain>, domain (the likeliest) and rate of every row."""
    members = fit_rates(stash(memberships(docs, labels), "members"), targets or TARGETS, total, highest)
    ps = F.array(*[F.col(f"p_{d}") for d in DOMAINS])
    likeliest = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.array_position(ps, F.array_max(ps)).cast("int"))
    return members.withColumn("domain", likeliest).withColumn("rate", F.round("w", 6)).drop("w")


def mixed(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, each as often as its rate says: the whole part, and once more with the rest's chance.

    The chance is decided by a hash of doc_id and text, so that a run repeats itself.
    """
    rates = mix(docs, labels, **how)
    chance = F.pmod(F.xxhash64("doc_id", "mark", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = rates.groupBy("doc_id", "mark").agg(F.max("rate").alias("rate")).withColumn("times", F.floor(F.col("rate") + chance).cast("int"))
    a, b, c = map(free, ("id", "mark", "times"))
    rates = rates.filter("times > 0").select(F.col("doc_id").alias(a), F.col("mark").alias(b), F.col("times").alias(c))
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.join(rates, F.col("doc_id").eqNullSafe(F.col(a)) & (mark == F.col(b)))
    return rows.withColumn(b, F.explode(F.array_repeat(F.lit(0), F.col(c)))).drop(a, b, c)
