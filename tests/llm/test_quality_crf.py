import itertools
import zlib

import numpy as np
import pytest

from slotline.llm import quality_crf as qc
from tests.conftest import TESTDATA


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    model = qc.Model(rng.normal(size=4), rng.normal(size=(2, 2)), (1.0, 0.0))
    chains = [rng.normal(size=(n, 4)) for n in (1, 5, 3, 2)]
    good, pairs, total = model.marginals(chains)
    want_pairs = np.zeros((2, 2))
    by_size = sorted(range(4), key=lambda i: -len(chains[i]))
    for place, i in enumerate(by_size):
        u, n = chains[i] @ model.weights, len(chains[i])
        paths = list(itertools.product((0, 1), repeat=n))
        scores = np.array([sum(u[t] for t in range(n) if p[t]) + sum(model.change[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        p = np.exp(scores - np.logaddexp.reduce(scores))
        assert np.isclose(total[place], np.logaddexp.reduce(scores))
        assert np.allclose(good[i], [sum(w for w, q in zip(p, paths, strict=True) if q[t]) for t in range(n)])
        for w, q in zip(p, paths, strict=True):
            for t in range(n - 1):
                want_pairs[q[t], q[t + 1]] += w
    assert np.allclose(pairs, want_pairs)


def test_line_features():
    own, size = qc.line_features(b"One two.\n\n*** ### one one\n")
    assert own.shape == (4, qc.OWN) and size.tolist() == [8, 1, 15, 1] and own[1, 11] == 1 and own[2, 6] == 0.25
    assert qc.line_features(b"")[0].shape == (1, qc.OWN)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in qc.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    known = [(got[r.doc_id], r.quality) for r in labels.collect()]
    held = [(g.predicted, y) for g, y in known if g.held_out]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) >= 0.95


def test_lines_of_both_labels():
    """Bad texts in which good lines stand between junk: the lines get labels of their own, and the texts stay bad."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeinrst"), rng.integers(2, 8)))
    good = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    junk = lambda: " | ".join(word().upper() + "!!" for _ in range(12))
    texts = ["\n".join(good() for _ in range(8)) for _ in range(60)] + ["\n".join(junk() for _ in range(8)) for _ in range(30)]
    mixed = ["\n".join(x for _ in range(4) for x in (junk(), good())) for _ in range(30)]
    model = qc.train([t.encode() for t in texts + mixed], np.repeat([1.0, 0.0], 60))
    right, scores = [], []
    for t in mixed:
        own, size = qc.line_features(t.encode())
        p = model.marginals([qc.with_neighbours(own)])[0][0]
        right += ((p >= 0.5) == [False, True] * 4).tolist()
        scores.append(model.score(qc.quality(p, size)))
    assert np.mean(right) > 0.9 and max(scores) < 0.5


def test_constraints_hold():
    rng = np.random.default_rng(0)
    model = qc.Model(rng.normal(size=4), rng.normal(size=(2, 2)), (1.0, 0.0))
    chains = [rng.normal(size=(n, 4)) for n in (1, 5, 3, 2)]
    sizes = [rng.integers(1, 9, len(c)) for c in chains]
    for label, holds in ((True, lambda q: q >= qc.GOOD_FROM), (False, lambda q: q <= qc.BAD_TO)):
        got, pairs = qc.constrained(model, chains, sizes, label)
        assert all(holds(qc.quality(g, s)) for g, s in zip(got, sizes, strict=True)) and np.isclose(pairs.sum(), 0 + 4 + 2 + 1)


def test_odd_rows(odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        got = qc.classify(odd_docs, labels).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert qc.classify(no_docs, labels).count() == 0


def test_lines(odd_docs, odd_labels):
    model = qc.fit(odd_docs, odd_labels)
    for r in qc.score(odd_docs.filter("doc_id = 9"), model).collect():
        text = odd_docs.filter("doc_id = 9").first().text.encode()
        assert [text[x.start : x.start + x.length] for x in r.lines] == text.split(b"\n")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 100, 1000])
def test_segments_equal_the_chain(n):
    rng = np.random.default_rng(n)
    model = qc.Model(rng.normal(size=1), rng.normal(size=(2, 2)), (1.0, 0.0))
    chain = rng.normal(size=(n, 1)) * 3
    assert np.allclose(model.long_marginals(chain @ model.weights), model.marginals([chain])[0][0])


def test_blocks_equal_the_whole_text():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=3 * qc.OWN + 3)
    for text in (b"", b"\n", b"a\nb b\n\nA Long line, with words.\na", b"\n".join(rng.choice([b"", b"x", b"Some words here.", b"### | ###"], 50))):
        own, size = qc.line_features(text)
        for block in (1, 2, 7, 100):
            got, sizes = qc.unaries(text, weights, block)
            assert np.allclose(got, qc.with_neighbours(own) @ weights) and (sizes == size).all()


def test_a_million_lines(spark, odd_docs, odd_labels):
    """A text of very many short lines is scored like a short one of the same kind, in bounded memory."""
    model = qc.train([b"Some words that are fine.\n" * 5, b"x\n" * 5] * 20, np.array([1.0, 0.0] * 20))
    docs = spark.createDataFrame([(1, "x\n" * 1_000_000), (2, "x\n" * 30_000), (3, "Some words that are fine.\n" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.n) for r in qc.score(docs, model).selectExpr("doc_id", "score", "size(lines) as n").collect()}
    assert got[1][1] == 1_000_001 and got[2][1] == 30_001 and got[3][1] == 20_001
    assert got[1][0] < 0.2 and got[2][0] < 0.2 and got[3][0] > 0.8
