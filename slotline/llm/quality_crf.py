"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line is labelled good or bad. Its features are its own, its neighbours' and whether
it has any; the chain adds a 2 x 2 transition. The marginals of forward-backward, weighted
with line lengths, are averaged into the text's quality, which a logistic curve fitted on
the training texts maps to a score.

Texts are labelled, lines aren't: a bad text may hold good lines. So training starts from
lines that have their text's label, by their own features alone, and goes on by expectation and maximisation with
constrained posteriors: lines keep what forward-backward says of them, but for a tilt, as
small as can be and in proportion to their length, that brings the quality of a good text
to GOOD_FROM or more and that of a bad one to BAD_TO or less; these expectations of lines
and of transitions are what the next weights are fitted to.

Bounds of the training sample (the only sample here): about TRAIN_DOCS labelled texts, a
share of all by hashed id, of at most TRAIN_BYTES bytes, no more than twice TRAIN_DOCS, and
of these, by hash, as many as hold TRAIN_LINES lines. Scoring reads every whole text; one of
more than LONG lines has its features worked out a block of lines at a time, and its chain
in segments side by side, so that it takes a few numbers for each line.

Defined cases. A null text is empty: one empty line. A null doc_id isn't held out. Labels
repeated for a doc_id count once, as the smallest; null labels don't count. Without any
label of either kind every score is the share of good labels, or 0.5. Repeated rows are
scored each for itself. Labels, language, source and ids are no features.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import hashed_share, texts

TRAIN_DOCS, TRAIN_BYTES, TRAIN_LINES = 4000, 30_000, 300_000
LONG = 16_384
GOOD_FROM, BAD_TO = 0.9, 0.5
THRESHOLD = 0.7
OWN = 13
SCORED = "doc_id long, score double, lines array<struct<start:long,length:long,p_good:double>>"

_KIND = np.zeros((256, 5), np.float32)  # letter, upper case, digit, white space, other ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (_c.isalpha() or _b >= 128, "A" <= _c <= "Z", "0" <= _c <= "9", _b in (9, 11, 12, 13, 32), 33 <= _b < 127 and not _c.isalnum() and _c not in ".,'")


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line of a text, and the lines' lengths in bytes."""
    lines = raw.split(b"\n")
    return features_of(lines, Counter(lines))


def features_of(lines: list[bytes], times: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """`line_features` of some of a text's lines; `times` says how often the text has each."""
    raw = b"\n".join(lines)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(n + 1) - n - 1
    sums = np.zeros((len(lines), 5), np.float64)
    if raw:
        counts = np.add.reduceat(_KIND[np.frombuffer(raw + b"\n", np.uint8)], starts, axis=0, dtype=np.float64)
        sums[:] = counts
    size = np.maximum(n, 1)
    words = np.empty((len(lines), 4))
    for k, line in enumerate(lines):
        w = line.split()
        words[k] = (len(w), len(set(w)), sum(map(bytes.__eq__, w, w[1:])), line[-1:] in b".!?" and len(line) > 0)
    again = np.fromiter((times[line] for line in lines), np.float64, len(lines))
    count = np.maximum(words[:, 0], 1)
    own = np.stack(
        [
            np.log1p(n) / 8,
            sums[:, 0] / size,
            np.minimum(1, sums[:, 1] / size * 4),
            sums[:, 2] / size,
            np.minimum(1, sums[:, 4] / size * 8),
            words[:, 1] / count,
            words[:, 2] / count,
            np.minimum(size / count / 10, 2),
            words[:, 3],
            np.log(again),
            words[:, 0] < 4,
            n == 0,
            sums[:, 4] / count > 0.3,
        ],
        axis=1,
    )
    return own, size


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after, one for a first and a last line, and a constant."""
    blank = np.zeros((1, OWN))
    edge = np.zeros((len(own), 3))
    edge[0, 0] = edge[-1, 1] = 1
    edge[:, 2] = 1
    return np.hstack([own, np.vstack([blank, own[:-1]]), np.vstack([own[1:], blank]), edge])


def unaries(raw: bytes, weights: np.ndarray, block: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """What `weights` give each line of a text, and the lines' lengths in bytes, a block of lines and its two neighbours at a time."""
    lines = raw.split(b"\n")
    times, out, sizes = Counter(lines), [], []
    for a in range(0, len(lines), block):
        first, last = max(0, a - 1), min(len(lines), a + block + 1)
        own, size = features_of(lines[first:last], times)
        rows = with_neighbours(own)
        rows[0, 3 * OWN] = first == 0
        rows[-1, 3 * OWN + 1] = last == len(lines)
        inner = slice(a - first, a - first + min(block, len(lines) - a))
        out.append(rows[inner] @ weights)
        sizes.append(size[inner])
    return np.concatenate(out), np.concatenate(sizes)


def _along(unary: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Forward messages of one chain (n x 2), in about root of n segments that move together.

    First each segment's effect on either entering label is worked out, then what enters each
    segment one after the other, then the messages within all segments.
    """
    n = len(unary)
    k = int(np.ceil(np.sqrt(n)))
    u = np.zeros((k, k, 2))
    u.reshape(-1, 2)[:n] = unary
    step = lambda a: np.logaddexp(a[..., :1] + change[0], a[..., 1:] + change[1])
    effect = change[None] + u[:, 0, None, :]
    for t in range(1, k):
        effect = step(effect) + u[:, t, None, :]
    out = np.empty_like(u)
    out[0, 0] = u[0, 0]
    for t in range(1, k):
        out[0, t] = step(out[0, t - 1]) + u[0, t]
    enter = np.empty((k, 2))
    if k > 1:
        enter[1] = out[0, -1]
    for j in range(2, k):
        enter[j] = np.logaddexp(enter[j - 1, 0] + effect[j - 1, 0], enter[j - 1, 1] + effect[j - 1, 1])
    now = enter[1:]
    for t in range(k if k > 1 else 0):
        now = step(now) + u[1:, t]
        out[1:, t] = now
    return out.reshape(-1, 2)[:n]


def groups(sizes: list[int], cells: int = 200_000, most: int = 500) -> Iterator[list[int]]:
    """Chains of a like length together, so that a padded group keeps within `cells` (or is one chain); those of more than LONG lines alone."""
    part: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if part and (sizes[i] > LONG or (len(part) + 1) * sizes[i] > cells or len(part) == most):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


@dataclass
class Model:
    weights: np.ndarray  # of the good label, one for each feature
    change: np.ndarray  # 2 x 2, from label to label
    curve: tuple[float, float]  # slope and place of the logistic curve

    def marginals(self, chains: list[np.ndarray], tilt: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """P(good) of each line, expected transitions in all, and each chain's log partition; `tilt` is added to the lines' scores.

        All chains move together, longest first; a step handles those that are as long.
        """
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        size = np.array([len(chains[i]) for i in order])
        unary = np.zeros((len(order), int(size[0]), 2))
        for row, i in enumerate(order):
            unary[row, : size[row], 1] = chains[i] @ self.weights + (0 if tilt is None else tilt[i])
        alpha, beta, live = np.zeros_like(unary), np.zeros_like(unary), np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        alpha[:, 0] = unary[:, 0]
        for t in range(1, size[0]):
            m = live[t]
            alpha[:m, t] = unary[:m, t] + np.logaddexp(alpha[:m, t - 1, :1] + self.change[0], alpha[:m, t - 1, 1:] + self.change[1])
        pairs = np.zeros((2, 2))
        total = np.logaddexp(*alpha[np.arange(len(order)), size - 1].T)
        for t in range(size[0] - 2, -1, -1):
            m = live[t + 1]
            after = unary[:m, t + 1] + beta[:m, t + 1]
            beta[:m, t] = np.stack([np.logaddexp(self.change[a, 0] + after[:, 0], self.change[a, 1] + after[:, 1]) for a in (0, 1)], axis=1)
            pairs += np.exp(alpha[:m, t, :, None] + self.change + after[:, None, :] - total[:m, None, None]).sum(axis=0)
        good = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None])
        out = [np.empty(0)] * len(order)
        for row, i in enumerate(order):
            out[i] = good[row, : size[row]]
        return out, pairs, total

    def long_marginals(self, unary: np.ndarray) -> np.ndarray:
        """P(good) of each line of one long chain, from its lines' scores; backward messages are forward ones of the chain turned round."""
        u = np.stack([np.zeros(len(unary)), unary], axis=1)
        both = _along(u, self.change) + _along(u[::-1], self.change.T)[::-1] - u
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))

    def score(self, quality: float) -> float:
        slope, place = self.curve
        return float(1 / (1 + np.exp(-np.clip(slope * (quality - place), -40, 40))))


def quality(good: np.ndarray, size: np.ndarray) -> float:
    """Length-weighted mean of the lines' marginals."""
    return float((good * size).sum() / size.sum())


def constrained(model: Model, chains: list[np.ndarray], sizes: list[np.ndarray], good_texts: bool, halvings: int = 8) -> tuple[list[np.ndarray], np.ndarray]:
    """P(good) of the lines of texts of one label, and expected transitions, with the smallest tilt that keeps their qualities' bound."""
    sign, bound = (1, GOOD_FROM) if good_texts else (-1, BAD_TO)
    shape = [s / s.mean() for s in sizes]
    low, high = np.zeros(len(chains)), np.full(len(chains), 40.0)  # the bound is kept at `high`
    for _ in range(halvings):
        mid = (low + high) / 2
        got, _, _ = model.marginals(chains, [sign * m * x for m, x in zip(mid, shape, strict=True)])
        kept = np.array([sign * (quality(g, s) - bound) >= 0 for g, s in zip(got, sizes, strict=True)])
        low, high = np.where(kept, low, mid), np.where(kept, mid, high)
    free, _, _ = model.marginals(chains)
    high[[sign * (quality(g, s) - bound) >= 0 for g, s in zip(free, sizes, strict=True)]] = 0
    got, pairs, _ = model.marginals(chains, [sign * m * x for m, x in zip(high, shape, strict=True)])
    return got, pairs


def train(texts_: list[bytes], labels: np.ndarray, steps: int = 40, rounds: int = 8, again: int = 12, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Maximum likelihood by Adam over the whole sample, in `rounds` rounds of expectations after the first, then the logistic curve on its qualities."""
    found = [line_features(t) for t in texts_]
    chains, sizes = [with_neighbours(own) for own, _ in found], [size for _, size in found]
    width = 3 * OWN + 3
    model = Model(np.zeros(width), np.zeros((2, 2)), (0.0, 0.0))
    share = float(np.mean(labels)) if len(labels) else 0.5
    if not 0 < share < 1 or not len(labels):
        return Model(model.weights, model.change, (0.0 if share == 0.5 else 1.0, -40.0 if share == 1 else 40.0 if share == 0 else 0.0))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # both labels count alike
    lines = sum(map(len, chains))
    parts = []
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        parts += [own[p] for p in groups([len(chains[i]) for i in own])]
    stacked = [np.concatenate([chains[i] for i in part]) for part in parts]

    def maximise(wanted: np.ndarray, seen: np.ndarray | None, steps: int) -> None:
        """Adam towards expected features and transitions (None: only a line's own features move)."""
        m, v = [np.zeros(width + 4) for _ in range(2)]
        for step in range(1, steps + 1):
            slope, moved = -wanted / lines, np.zeros((2, 2)) if seen is None else -seen / lines
            for part, rows in zip(parts, stacked, strict=True):
                w = weight[part[0]]
                good, pairs, _ = model.marginals([chains[i] for i in part])
                slope = slope + w * rows.T @ np.concatenate(good) / lines
                moved = moved if seen is None else moved + w * pairs / lines
            if seen is None:
                slope[OWN:-1] = 0
            g = np.concatenate([slope, moved.ravel()]) + penalty * np.concatenate([model.weights, model.change.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            by = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            model.weights, model.change = model.weights - by[:width], model.change - by[width:].reshape(2, 2)

    wanted = sum(w * c.sum(axis=0) * y for c, y, w in zip(chains, labels, weight, strict=True))
    maximise(wanted, None, steps)  # lines that all have their text's label would only teach the chain to stay, and to follow neighbours
    for _ in range(rounds):
        wanted, seen = np.zeros(width), np.zeros((2, 2))
        for part, rows in zip(parts, stacked, strict=True):
            got, pairs = constrained(model, [chains[i] for i in part], [sizes[i] for i in part], bool(labels[part[0]]))
            wanted, seen = wanted + weight[part[0]] * rows.T @ np.concatenate(got), seen + weight[part[0]] * pairs
        maximise(wanted, seen, again)
    q = np.empty(len(chains))
    for part in parts:
        good, _, _ = model.marginals([chains[i] for i in part])
        q[part] = [quality(g, sizes[i]) for g, i in zip(good, part, strict=True)]
    a, b = 1.0, 0.0
    for _ in range(500):  # logistic regression on one number
        p = 1 / (1 + np.exp(-np.clip(a * q + b, -40, 40)))
        d = (p - labels) / len(q)
        h = p * (1 - p) / len(q) + 1e-9
        hess = np.array([[(h * q * q).sum() + 1e-4, (h * q).sum()], [(h * q).sum(), h.sum()]])
        da, db = np.linalg.solve(hess, [(d * q).sum() + 1e-4 * (a - 1), d.sum()])
        a, b = a - 0.5 * da, b - 0.5 * db
    a = max(a, 1e-3)
    return Model(model.weights, model.change, (a, -b / a))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """A model from a bounded sample of the labelled texts that aren't held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    short = texts(docs).filter(F.octet_length("text") <= train_bytes)
    chosen = hashed_share(known, train_docs, "doc_id")
    chosen = chosen.orderBy(F.xxhash64("doc_id")).limit(2 * train_docs)
    rows = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(2 * train_docs)
    got = rows.toPandas()
    got = got[(got["text"].str.count("\n") + 1).cumsum() <= TRAIN_LINES]
    return train([t.encode() for t in got["text"]], got["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and its lines with place, length in bytes and P(good)."""
    saved = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(saved)
        line = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("p_good", pa.float64())])
        for b in batches:
            raw = [t.encode() for t in b.column("text").to_pylist()]
            for part in groups([t.count(b"\n") + 1 for t in raw]):
                if raw[part[0]].count(b"\n") >= LONG:  # such texts come one by one
                    unary, size = unaries(raw[part[0]], model.weights)
                    good, sizes = [model.long_marginals(unary)], [size]
                else:
                    found = [line_features(raw[i]) for i in part]
                    good, _, _ = model.marginals([with_neighbours(own) for own, _ in found])
                    sizes = [size for _, size in found]
                scores = [model.score(quality(g, size)) for g, size in zip(good, sizes, strict=True)]
                length = [np.fromiter(map(len, raw[i].split(b"\n")), np.int64) for i in part]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in length])]).astype(np.int32)
                starts = np.concatenate([np.cumsum(x + 1) - x - 1 for x in length])
                flat = pa.StructArray.from_arrays([pa.array(starts), pa.array(np.concatenate(length)), pa.array(np.concatenate(good))], fields=list(line))
                lines = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(part)), pa.array(scores, pa.float64()), lines], ["doc_id", "score", "lines"])

    return texts(docs).mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The query's form: doc_id, held_out, score, predicted, and how many lines are good."""
    scored = score(docs, fit(docs, labels))
    good = F.size(F.filter("lines", lambda x: x.p_good >= 0.5))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("lines").alias("n_lines"), good.alias("n_good_lines"))
