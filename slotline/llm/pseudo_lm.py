"""Language-model scoring by masked pseudo-likelihood.

Words (runs between ASCII white space, A-Z lowered; told apart by a 64-bit hash) are counted
over all texts. Words sorted by count are cut into CLASSES classes of about equal mass, the
commonest words alone in theirs and words of one count together. A window network, trained
in numpy, sees the WINDOW words on either side of a masked word and predicts it in two
factors: P(class | both sides), and P(word | class), the word's share of its class. Around
the masked word it sees the NAMED commonest words as themselves and others as their class:
these are its tokens. A text's score is the sum of the log probabilities of all its words,
each with every other word of its window in sight.

Counts cover all texts, and so does the network's training: every word of every text is gone
over once, in rounds that each take a share of the texts (ROUNDS) by a hash. In a round each
task goes on from the same weights over its texts, and the tasks' weights are averaged by
their words; the first round starts from a seed and the classes' masses. The vocabulary
grows with the corpus: tasks get the counts of the HOT commonest words, and all rarer words
are joined to their counts. Counts of 2^EXACT or more keep their first EXACT bits, so that
there is a bound on how many different ones there are.

Defined cases. A null text is empty; a text without words has 0 words, sum and mean 0. Null
ids stay null. Repeated rows are counted and scored each. A word that no text of the fit has
is of the rarest class, with half a word's share. Of other columns nothing is read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import small_batches, stash, texts, tidy
from slotline.llm.words import chunks

HOT, NAMED, CLASSES, WINDOW = 1 << 18, 256, 128, 2
WIDTH, HIDDEN = 16, 32
EXACT = 14
#: Sixteenths of the texts up to which a round goes, its words a step and its step size.
ROUNDS = ((1, 512, 0.003), (4, 2048, 0.003), (16, 2048, 0.0015))
EDGE = NAMED + CLASSES  # the token beyond a text's ends
JOINED = 65_535  # in place of a token: a word whose count is joined


def word_ids(text: str) -> np.ndarray:
    """A text's words as signed 64-bit hashes."""
    return np.concatenate([w for *_, w, _ in chunks(pa.array([text]))]).view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """bucket (a word's hash), n over all texts; tasks send a row for each word of about a million words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def met() -> Iterator[pa.RecordBatch]:
            words, n = np.unique(np.concatenate(waiting), return_counts=True)
            for k in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000]), pa.array(n[k : k + 50_000])], ["bucket", "n"])

        for b in batches:
            for _, _, words, _ in chunks(b.column("text")):
                waiting.append(words.view(np.int64))
                held += len(words)
                if held >= 1_000_000:
                    yield from met()
                    waiting, held = [], 0
        if held:
            yield from met()

    n = F.expr(f"if(n < {1 << EXACT}, n, n - n % shiftleft(1L, length(bin(n)) - {EXACT}))")
    return texts(docs).select("text").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("n", n)


@dataclass
class Hot:
    """Values of the hot words by their sorted hashes; other words have `rest`."""

    words: np.ndarray
    values: np.ndarray
    rest: float

    def __getitem__(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), self.rest, self.values.dtype)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            np.copyto(out, self.values[at], where=self.words[at] == words)
        return out


@dataclass
class Vocabulary:
    """Classes and log shares of all words: by count (n ascending, the first is 0), and by hash of the hot words."""

    counts: DataFrame  # bucket, n of all words
    n: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    mass: np.ndarray  # of each class
    hot: np.ndarray
    hot_n: np.ndarray
    hot_token: np.ndarray
    of_token: np.ndarray  # each token's class
    least: int  # words that occur so often are hot


def vocabulary(docs: DataFrame, hot: int = HOT) -> Vocabulary:
    small_batches(docs.sparkSession)
    counts = stash(word_counts(docs), "words")
    got = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow()  # a row for each different count: under a million
    n, words = got["n"].to_numpy(), got["words"].to_numpy()
    order = np.argsort(n)
    n, words = np.concatenate([[0], n[order]]), np.concatenate([[1], words[order]])  # one word is unseen
    from_here = np.cumsum(words[::-1])[::-1]
    least = int(n[np.flatnonzero(from_here <= hot)[0]]) if (from_here <= hot).any() else int(n[-1]) + 1
    often = counts.filter(F.col("n") >= least).toArrow()  # `hot` rows at most
    by_hash = np.argsort(often["bucket"].to_numpy())
    classes, within, mass = by_count(n, words)
    often, often_n = often["bucket"].to_numpy()[by_hash], often["n"].to_numpy()[by_hash]
    return Vocabulary(counts, n, classes, within, mass, often, often_n, *tokens_of(often_n, classes[np.searchsorted(n, often_n)]), max(1, least))


def tokens_of(counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token of each of these words, and each token's class: 0 to NAMED - 1 are the commonest words, further ones all others' classes."""
    named = np.lexsort((np.arange(len(counts)), -counts))[:NAMED]
    token = classes.astype(np.uint16) + np.uint16(NAMED)
    token[named] = np.arange(len(named))
    of_token = np.concatenate([np.zeros(NAMED, np.uint8), np.arange(CLASSES, dtype=np.uint8)])
    of_token[: len(named)] = classes[named]
    return token, of_token


@dataclass
class Model:
    tokens: np.ndarray | Hot  # of each word
    within: np.ndarray | Hot  # log P(word | class)
    of_token: np.ndarray  # each token's class
    embed: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    vocabulary: Vocabulary | None = None

    def tables(self) -> np.ndarray:
        """For each place in the window, what each token adds to the hidden layer."""
        return np.stack([self.embed @ self.first[p * WIDTH : (p + 1) * WIDTH] for p in range(2 * WINDOW)])


def by_count(n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of about equal mass for counts n (ascending) that so many words have, each word's
    smoothed log share of its class, and the classes' masses."""
    smooth = n + 0.5
    own = smooth * words
    after = np.append(np.cumsum(own[::-1])[::-1][1:], 0)  # the mass of commoner words
    classes = np.minimum(CLASSES - 1, after / own.sum() * CLASSES).astype(np.uint8)
    if len(n) > 1 and n[0] == 0:  # no text shows a class of unseen words
        classes[0] = classes[1]
    mass = np.bincount(classes, weights=own, minlength=CLASSES)
    return classes, np.log(smooth / mass[classes]).astype(np.float32), mass


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`by_count` for each of these words."""
    n, at, words = np.unique(counts, return_inverse=True, return_counts=True)
    classes, within, _ = by_count(n, words)
    return classes[at], within[at]


def windows(c: np.ndarray) -> np.ndarray:
    """The tokens around each word, words x 2 WINDOW."""
    return next(blocks(c, max(1, len(c))))[0]


def blocks(c: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tokens around each word and the words' own, so many words at a time; a block's windows reach into its neighbours."""
    padded = np.pad(c.astype(np.int16), WINDOW, constant_values=EDGE)
    for k in range(0, max(1, len(c)), size):
        own = padded[k : k + size + 2 * WINDOW]
        n = len(own) - 2 * WINDOW
        yield np.stack([own[d : d + n] for d in range(2 * WINDOW + 1) if d != WINDOW], axis=1), c[k : k + size]


def hidden(tables: np.ndarray, bias: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = tables[0].take(x[:, 0], axis=0) + bias
    for place in range(1, 2 * WINDOW):
        h += tables[place].take(x[:, place], axis=0)
    return np.tanh(h, out=h)


def exponents(h: np.ndarray, second: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The outputs z, less the row's largest where exp could leave its range, exp(z) and its sums."""
    z = h @ second
    z += bias
    if (np.abs(second).sum(axis=0) + np.abs(bias)).max() > 80:  # |h| is 1 at most
        z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return z, e, e @ np.ones(CLASSES, np.float32)


class Trainer:
    """Adam on the cross entropy of the masked word's class; p is embed, first, first_bias, second and second_bias."""

    def __init__(self, p: list[np.ndarray], rate: float) -> None:
        self.p, self.rate, self.step = list(p), rate, 0
        self.m, self.v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """A step along the mean gradient of these words."""
        n, (embed, first, first_bias, second, second_bias) = len(y), self.p
        places = first.reshape(2 * WINDOW, WIDTH, HIDDEN)
        h = hidden(embed @ places, first_bias, x)
        _, z, total = exponents(h, second, second_bias)
        z *= (1 / total)[:, None]
        z[np.arange(n), y] -= 1
        z *= np.float32(1 / n)
        dh = (z @ second.T) * (1 - h * h)
        # sums of dh by place and token give the gradients of both embed and first
        of = (x + np.arange(2 * WINDOW, dtype=np.int16) * (EDGE + 1)).T.ravel()
        order = np.argsort(of, kind="stable")
        of = of[order]
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sums = np.zeros((2 * WINDOW * (EDGE + 1), HIDDEN), np.float32)
        sums[of[begin]] = np.add.reduceat(dh.take(order % n, axis=0), begin, axis=0)
        sums = sums.reshape(2 * WINDOW, EDGE + 1, HIDDEN)
        self.step += 1
        for i, g in enumerate(((sums @ places.transpose(0, 2, 1)).sum(axis=0), (embed.T @ sums).reshape(first.shape), dh.sum(axis=0), h.T @ z, z.sum(axis=0))):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = (self.p[i] - self.rate * (self.m[i] / (1 - 0.9**self.step)) / (np.sqrt(self.v[i] / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)


def train(chains: list[np.ndarray], counts: np.ndarray, epochs: int = 2, batch: int = 512, rate: float = 0.003, seed: int = 7) -> Model:
    """A network trained on these texts alone, at the driver."""
    classes, within = classes_of(counts)
    mass = np.bincount(classes, weights=counts + 0.5, minlength=CLASSES)
    tokens, of_token = tokens_of(counts, classes)
    return Model(tokens, within, of_token, *start([tokens[c] for c in chains if len(c)], of_token, mass, epochs, batch, rate, seed))


def seeded(mass: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Weights that say little but the classes' masses."""
    f32 = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return [f32(EDGE + 1, WIDTH), f32(2 * WINDOW * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), f32(HIDDEN, CLASSES), np.log((mass + 1e-3) / mass.sum()).astype(np.float32)]


def start(chains: list[np.ndarray], of_token: np.ndarray, mass: np.ndarray, epochs: int = 2, batch: int = 512, rate: float = 0.003, seed: int = 7) -> list[np.ndarray]:
    """Weights trained on the tokens of these texts alone, at the driver."""
    rng = np.random.default_rng(seed)
    trainer = Trainer(seeded(mass, rng), rate)
    if chains:
        x, y = np.concatenate([windows(c) for c in chains]), of_token[np.concatenate(chains)]
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                own = order[k : k + batch]
                trainer.fit(x[own], y[own])
    return trainer.p


def train_all(chains: DataFrame, of_token: np.ndarray, mass: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Weights trained by every word of all chains (`tokens`: two bytes per word), a share of them in each round."""
    p, low = seeded(mass, np.random.default_rng(seed)), 0
    share = F.pmod(F.xxhash64("tokens", "doc_id"), F.lit(16))
    for high, batch, rate in ROUNDS:
        p, low = train_on(chains.filter((share >= low) & (share < high)), of_token, p, batch, rate), high
    return p


def train_on(chains: DataFrame, of_token: np.ndarray, p: list[np.ndarray], batch: int, rate: float) -> list[np.ndarray]:
    """The weights p trained on by every word of these chains.

    Each task goes once over its chains, from p; the tasks' weights are averaged by their words.
    """
    sizes = [a.size for a in p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, xs, ys, held, words = Trainer(p, rate), [], [], 0, 0
        rng = np.random.default_rng(7)

        def steps() -> None:
            """Words near each other go to different steps."""
            x, y = np.concatenate(xs), np.concatenate(ys)
            order = rng.permutation(len(y))
            for own in np.array_split(order, -(-len(order) // batch)):
                trainer.fit(x[own], y[own])

        for b in batches:
            for c in b.column("tokens").to_pylist():
                if not c:
                    continue
                for x, y in blocks(np.frombuffer(c, np.uint16), 32 * batch):
                    xs.append(x)
                    ys.append(of_token[y])
                    held, words = held + len(y), words + len(y)
                    if held >= 32 * batch:
                        steps()
                        xs, ys, held = [], [], 0
        if held:
            steps()
        if words:
            flat = np.concatenate([a.ravel() for a in trainer.p]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * words), pa.array(np.full(len(flat), words))], ["place", "weight", "words"])

    got = chains.select("tokens").mapInArrow(tidy(run), "place long, weight double, words long").groupBy("place").agg((F.sum("weight") / F.sum("words")).alias("weight")).toArrow()
    if not got.num_rows:
        return p
    flat = np.empty(sum(sizes), np.float32)
    flat[got["place"].to_numpy()] = got["weight"].to_numpy()
    return [part.reshape(a.shape) for part, a in zip(np.split(flat, np.cumsum(sizes)[:-1]), p, strict=True)]


def log_likelihood(model: Model, tables: np.ndarray, buckets: np.ndarray, block: int = 1024) -> float:
    """Sum of the conditional log probabilities of a text's words."""
    return float(model.within[buckets].sum(dtype=np.float64)) + of_classes(model, tables, model.tokens[buckets], block)


def of_classes(model: Model, tables: np.ndarray, c: np.ndarray, block: int = 2048) -> float:
    """Sum of the log probabilities of the classes of a text's tokens c."""
    total = 0.0
    for x, y in blocks(c, block):
        z, _, sums = exponents(hidden(tables, model.first_bias, x), model.second, model.second_bias)
        total += float((z[np.arange(len(y)), model.of_token[y]] - np.log(sums)).sum(dtype=np.float64))
    return total


def of_all(model: Model, tables: np.ndarray, chains: list[np.ndarray], block: int = 2048) -> np.ndarray:
    """`of_classes` of each of several texts; short ones share a block, with edges between them."""
    size, out = np.array([len(c) for c in chains], np.int64), np.zeros(len(chains))
    short = np.flatnonzero((size > 0) & (size <= block))
    upto = np.cumsum(size[short])
    a = 0
    while a < len(short):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + block, "right")))
        own = short[a:b]
        y, n = np.concatenate([chains[k] for k in own.tolist()]), size[own]
        begin = np.cumsum(n) - n
        at = np.arange(len(y)) + np.repeat(WINDOW * np.arange(1, len(own) + 1), n)
        padded = np.full(len(y) + WINDOW * (len(own) + 1), EDGE, np.int16)
        padded[at] = y
        x = np.stack([padded[at + d] for d in range(-WINDOW, WINDOW + 1) if d], axis=1)
        z, _, sums = exponents(hidden(tables, model.first_bias, x), model.second, model.second_bias)
        out[own] = np.add.reduceat((z[np.arange(len(y)), model.of_token[y]] - np.log(sums)).astype(np.float64), begin)
        a = b
    for k in np.flatnonzero(size > block).tolist():
        out[k] = of_classes(model, tables, chains[k], block)
    return out


CHAINS = "row long, doc_id long, bytes long, n_words long, within double, tokens binary, places binary"


def chains_of(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """For each text doc_id, bytes, n_words, within (its words' summed log shares) and tokens (two bytes per word).

    A text's rare words go to their counts as rows of their own (row, word, k: the word's place
    among the text's rare words) and come back as a list; `places` says where they stand.
    """
    hot = Hot(v.hot, np.arange(len(v.hot), dtype=np.int32), -1)
    shares = np.append(v.within[np.searchsorted(v.n, v.hot_n)].astype(np.float64), 0)  # the last ones are for rare words
    tokens = np.append(v.hot_token, np.uint16(JOINED))
    classes, within = v.classes, v.within.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            size = pc.binary_length(b.column("text"))
            for first, last, words, cuts in chunks(b.column("text")):
                at, m = hot[words.view(np.int64)], last - first
                gone = np.flatnonzero(at < 0)
                c, share = tokens[at], shares[at]
                sums = np.diff(np.concatenate([[0.0], np.cumsum(share)])[cuts])
                # each text's rare words: which different ones it has, and which of them stands where
                text = np.searchsorted(cuts, gone, "right") - 1
                order = np.lexsort((words[gone], text))
                text, rare = text[order], words[gone][order]
                new = np.ones(len(rare), bool)
                new[1:] = (text[1:] != text[:-1]) | (rare[1:] != rare[:-1])
                number = np.cumsum(new) - 1
                begin = np.searchsorted(text[new], np.arange(m + 1))
                place = np.empty(len(rare), np.int32)
                place[order] = number - begin[text]
                met = np.searchsorted(gone, cuts)
                none = lambda kind, k=m: pa.nulls(k, kind)
                part = lambda x, ends: pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(m)), b.column("doc_id").slice(first, m), size.slice(first, m).cast(pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(sums), part(c, cuts), part(place, met), none(pa.int64()), none(pa.int64())], names)
                if len(rare):
                    none = lambda kind, k=int(new.sum()): pa.nulls(k, kind)
                    yield pa.RecordBatch.from_arrays([pa.array(row + text[new]), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.binary()), none(pa.binary()), pa.array(rare[new].view(np.int64)), pa.array((number - begin[text])[new])], names)
                row += m

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, places, share, came in zip(*(b.column(x).to_pylist() for x in ("tokens", "places", "within", "came")), strict=True):
                c, came = np.frombuffer(c, np.uint16).copy(), np.array(came, np.int64)
                count = np.empty(len(came), np.int64)
                count[came >> 32] = came & 0xFFFFFFFF
                at = np.searchsorted(v_n, count)[np.frombuffer(places, np.int32)]
                c[c == JOINED] = classes[at].astype(np.uint16) + np.uint16(NAMED)
                out.append((share + float(within[at].sum()), c.tobytes()))
            share, c = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept[:3]), pa.array(share, pa.float64()), pa.array(c, pa.binary())], kept)

    kept, v_n = ["doc_id", "bytes", "n_words", "within", "tokens"], v.n
    names = ["row", *kept, "places", "bucket", "k"]
    sent = stash(texts(docs).mapInArrow(tidy(run), f"{CHAINS}, bucket long, k long"), "chains")
    rows = sent.filter("bucket is null")
    rare = sent.filter("bucket is not null").select("row", "bucket", "k")
    known = v.counts.filter(F.col("n") < v.least)
    came = rare.join(known, "bucket", "left").select("row", (F.shiftleft("k", 32) + F.coalesce("n", F.lit(0))).alias("one"))
    came = came.groupBy("row").agg(F.collect_list("one").alias("came"))
    joined = rows.filter("length(places) > 0").join(came, "row").select(*kept, "places", "came").mapInArrow(fill, "doc_id long, bytes long, n_words long, within double, tokens binary")
    return stash(rows.filter("length(places) = 0").select(*kept).union(joined), "tokens")


def fit(docs: DataFrame, hot: int = HOT) -> Model:
    """Counts and network of all texts."""
    v = vocabulary(docs, hot)
    return fit_chains(v, chains_of(docs, v))


def fit_chains(v: Vocabulary, chains: DataFrame) -> Model:
    within = v.within[np.searchsorted(v.n, v.hot_n)]
    return Model(Hot(v.hot, v.hot_token, v.classes[0] + np.uint16(NAMED)), Hot(v.hot, within, v.within[0]), v.of_token, *train_all(chains, v.of_token, v.mass), v)


def score_chains(chains: DataFrame, model: Model) -> DataFrame:
    saved = pickle.dumps(replace(model, tokens=None, within=None, vocabulary=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(saved)
        tables = model.tables()
        for b in batches:
            n = b.column("n_words")
            got = b.column("within").to_numpy() + of_all(model, tables, [np.frombuffer(c, np.uint16) for c in b.column("tokens").to_pylist()])
            got = np.where(n.to_numpy() > 0, got, 0.0)
            mean = got / np.maximum(1, n.to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, pa.array(got, pa.float64()), pa.array(mean, pa.float64())], ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return chains.select("doc_id", "n_words", "within", "tokens").mapInArrow(tidy(run), "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood (the sum) and mean_log_likelihood (a word)."""
    return score_chains(chains_of(docs, model.vocabulary), model)


def score_own(docs: DataFrame) -> DataFrame:
    """`score` of the texts by the model that they fit; their classes are found once."""
    v = vocabulary(docs)
    chains = chains_of(docs, v)
    return score_chains(chains, fit_chains(v, chains))
