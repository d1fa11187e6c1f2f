import numpy as np
import pytest
from pyspark.sql import functions as F

from slotline.llm import mixing as mx
from tests.conftest import TESTDATA


def tables(spark, sf):
    return tuple(spark.read.parquet(f"{TESTDATA}/{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_totals_reach_the_targets(spark):
    out = mx.mix(*tables(spark, "sf0.01")).cache()
    assert out.filter("rate < 0").isEmpty() and out.count() == 1000
    got = np.array([out.agg(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}"))).first()[0] for d in mx.DOMAINS])
    want = np.array([mx.TARGETS[d] for d in mx.DOMAINS])
    assert np.allclose(got / got.sum(), want, atol=0.002)
    ps = out.select(*[f"p_{d}" for d in mx.DOMAINS]).toPandas().to_numpy()
    assert np.allclose(ps.sum(axis=1), 1)


def test_rates_are_the_best_ones(spark):
    """Against plain projected gradient descent in numpy, run to the end, where targets bind at rate 0 and can't all be met."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4] * 4, 200)
    t = rng.integers(1, 100, 200)
    rows = [(int(n), *map(float, q)) for n, q in zip(t, p, strict=True)]
    members = spark.createDataFrame(rows, "tokens long, " + ", ".join(f"p_{d} double" for d in mx.DOMAINS)).cache()
    targets = {"good": 0.97, "good_toxic": 0.01, "bad": 0.01, "bad_toxic": 0.01}
    got = mx.fit_rates(members, targets, total=3000.0, iterations=120).select("w", *members.columns).toPandas().to_numpy()
    assert len(got) == 200
    got, t, p = got[:, 0], got[:, 1], got[:, 2:]  # the rows come in any order
    a, goal = t[:, None] * p, 3000.0 * np.array(list(targets.values()))
    inverse = np.linalg.inv((t[:, None] * p).T @ p)
    w = np.ones(200)
    for _ in range(5000):
        w = np.maximum(0, w - p @ inverse @ (w @ a - goal))
    loss = lambda x: (x @ a - goal) @ inverse @ (x @ a - goal)
    assert (got >= 0).all() and loss(got) <= loss(w) + 1e-3 * loss(np.ones(200))


def test_held_out_accuracy(spark):
    docs, labels = tables(spark, "sf0.01")
    got = mx.memberships(docs, labels.filter("doc_id % 4 <> 2"))
    bad = (F.col("p_bad") + F.col("p_bad_toxic")) > 0.5
    rows = got.join(labels.filter("doc_id % 4 = 2"), "doc_id").select(bad.alias("bad"), "quality").collect()
    assert len(rows) > 50 and np.mean([r.bad == (r.quality == 0) for r in rows]) >= 0.88


def test_odd_rows(odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        got = mx.mix(odd_docs, labels).collect()
        assert len(got) == odd_docs.count() and all(r.rate == 1 for r in got if not r.tokens) and all(r.rate >= 0 for r in got)
        out = mx.mixed(odd_docs, labels)
        assert out.columns == odd_docs.columns and {3, 4, 5} <= {r.doc_id for r in out.collect()}
        assert mx.mix(no_docs, labels).count() == 0 and mx.mixed(no_docs, labels).count() == 0


@pytest.mark.parametrize("rates", [(0.0, 1.0, 2.5)])
def test_rates_take_effect(spark, rates, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}", k % 3) for k in range(600)], "doc_id long, text string, times int")
    fake = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.element_at(F.array(*map(F.lit, rates)), F.col("times") + 1).alias("rate"))
    monkeypatch.setattr(mx, "mix", lambda *a, **b: fake)
    got = {r.times: r["count"] for r in mx.mixed(docs, None).groupBy("times").count().collect()}
    assert 0 not in got and got[1] == 200 and 460 <= got[2] <= 540
