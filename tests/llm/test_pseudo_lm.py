import numpy as np

from slotline.llm import pseudo_lm as lm
from tests.conftest import TESTDATA


def test_counts_cover_all_texts(spark, odd_docs):
    got = {r.bucket: r.n for r in lm.word_counts(odd_docs).collect()}
    want = {}
    for r in odd_docs.collect():
        for k in lm.word_ids(r.text or "").tolist():
            want[k] = want.get(k, 0) + 1
    assert got == want


def test_classes_are_of_like_mass():
    counts = np.zeros(200_000)
    counts[:5000] = 1e6 / np.arange(1, 5001)
    classes, within = lm.classes_of(counts)
    for c in np.unique(classes)[:20]:
        assert np.isclose(np.exp(within[classes == c].astype(float)).sum(), 1, atol=1e-3)


def test_likelihood_equals_plain_sums():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, 4000)
    model = lm.train([rng.integers(0, 4000, 300)], counts, epochs=1)
    words = rng.integers(0, 4000, 7)
    tokens, total = model.tokens[words].astype(int), 0.0
    c = model.of_token[tokens].astype(int)
    assert (tokens < lm.NAMED).any() and (tokens >= lm.NAMED).any()
    for t in range(7):
        around = [tokens[t + d] if 0 <= t + d < 7 else lm.EDGE for d in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate([model.embed[x] for x in around]) @ model.first + model.first_bias)
        z = (h @ model.second + model.second_bias).astype(float)
        total += z[c[t]] - np.logaddexp.reduce(z) + model.within[words[t]]
    assert np.isclose(lm.log_likelihood(model, model.tables(), words, block=3), total, atol=1e-2)


def test_both_sides_help(spark):
    """On texts not trained on, the network beats the class frequencies of the texts it was trained on."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    model = lm.fit(docs.filter("doc_id % 4 <> 2"))
    known, texts = ([r.text for r in docs.filter(f"doc_id % 4 {x} 2").collect()] for x in ("<>", "="))
    tables = model.tables()
    classes = lambda t: model.of_token[model.tokens[lm.word_ids(t)]]
    share = np.bincount(np.concatenate([classes(t) for t in known]), minlength=lm.CLASSES) + 1.0
    log_share = np.log(share / share.sum())
    net = alone = 0.0
    for t in texts:
        w = lm.word_ids(t)
        net += lm.log_likelihood(model, tables, w)
        alone += float((log_share[classes(t)] + model.within[w]).sum())
    assert net > alone


def test_odd_rows(odd_docs, no_docs):
    got = lm.score(odd_docs, lm.fit(odd_docs)).collect()
    assert len(got) == odd_docs.count() and all((r.n_words, r.log_likelihood, r.mean_log_likelihood) == (0, 0, 0) for r in got if r.doc_id in (3, 4, 5))
    assert all(r.log_likelihood < 0 for r in got if r.n_words)
    assert lm.score(no_docs, lm.fit(no_docs)).count() == 0


def test_network_learns_from_all_texts(spark):
    """A passage that only one text holds, and a long one, is learned by its network, and not by one of the other texts."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    noise = [(k, " ".join(rng.choice(words, 40))) for k in range(40)]
    passage = " ".join(words) + " "
    docs = spark.createDataFrame([*noise, (40, passage * 2500)], "doc_id long, text string").repartition(2)
    model = lm.fit(docs)
    v = model.vocabulary
    bounded = lm.Model(model.tokens, model.within, v.of_token, *lm.start([model.tokens[lm.word_ids(t)] for _, t in noise], v.of_token, v.mass), v)
    near, far = (lm.log_likelihood(m, m.tables(), lm.word_ids(passage)) for m in (model, bounded))
    assert near > far + 60


def test_windows_of_blocks_reach_across():
    c = np.random.default_rng(1).integers(0, lm.EDGE, 50).astype(np.uint16)
    parts = list(lm.blocks(c, 7))
    assert (np.concatenate([x for x, _ in parts]) == lm.windows(c)).all() and (np.concatenate([y for _, y in parts]) == c).all()


def test_every_word_has_its_own_count(spark):
    """More words than any table of a fixed size holds here; joined counts give the same scores as counts at hand."""
    rng = np.random.default_rng(5)
    rows = [(k, f"the {' '.join(f'x{k}y{j}' for j in range(300))} and " + " ".join(f"c{j}" for j in rng.zipf(1.5, 60) % 200)) for k in range(1000)]
    docs = spark.createDataFrame([*rows, (None, "the the x1y1 x1y1 new"), (1, "")], "doc_id long, text string").repartition(3)
    want = {}
    for r in docs.collect():
        for w in r.text.split():
            want[w] = want.get(w, 0) + 1
    v = lm.vocabulary(docs, hot=50)
    assert len(want) > 250_000 and v.counts.count() == len(want) and len(v.hot) <= 50
    got = lm.chains_of(docs, v).collect()
    place = {int(n): k for k, n in enumerate(v.n)}
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 2
    for doc_id, text in [*rows[:20:7], (None, "the the x1y1 x1y1 new")]:
        at = [place[want[w]] for w in text.split()]
        assert v.of_token[np.frombuffer(by_id[doc_id].tokens, np.uint16)].tolist() == v.classes[at].tolist() and np.isclose(by_id[doc_id].within, v.within[at].astype(float).sum(), rtol=1e-4)
    share = np.bincount(v.classes[[place[n] for n in want.values()]], weights=np.exp([float(v.within[place[n]]) for n in want.values()]), minlength=lm.CLASSES)
    assert all(np.isclose(x, 1, atol=1e-2) for x in share if x)


def test_rounds_cover_every_word_once(spark, monkeypatch):
    """The shares of the rounds are disjoint and whole."""
    docs = spark.createDataFrame([(k, f"w{k} x y z") for k in range(500)] + [(None, "a b")] * 3, "doc_id long, text string")
    v = lm.vocabulary(docs)
    chains, seen = lm.chains_of(docs, v), []
    monkeypatch.setattr(lm, "train_on", lambda rows, of_token, p, batch, rate: (seen.append(rows.count()), p)[1])
    lm.train_all(chains, v.of_token, v.mass)
    assert sum(seen) == 503 and all(seen) and len(seen) == len(lm.ROUNDS)


def test_large_counts_are_few(spark):
    """Counts keep their first bits from a limit on, and stay in order."""
    text = "a " * 20_001 + "b " * 20_002 + "c " * 40_000 + "d"
    got = sorted(r.n for r in lm.word_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert got == [1, 20_000, 20_002, 40_000]


def test_texts_that_share_a_block():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 5, 4000)
    model = lm.train([rng.integers(0, 4000, 300)], counts, epochs=1)
    chains = [model.tokens[rng.integers(0, 4000, n)] for n in (0, 1, 2, 30, 0, 7, 64, 65, 200, 3, 0)]
    got = lm.of_all(model, model.tables(), chains, block=64)
    assert np.allclose(got, [lm.of_classes(model, model.tables(), c) if len(c) else 0 for c in chains], atol=1e-3)
    assert lm.of_all(model, model.tables(), []).tolist() == []
