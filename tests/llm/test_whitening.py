from fractions import Fraction

import numpy as np
import pytest

from slotline.llm import whitening as wh
from slotline.llm.queries import op12_embedding_whitening
from tests.conftest import TESTDATA


def whole(rows):
    fine = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    return fine


def brute(rows, weighted=False):
    """Per id: n, exact deviation, whitened components up to sign, and their shares."""
    fine = whole(rows)
    xs = [x for _, x in fine] if weighted else sorted({tuple(x) for _, x in fine})
    n, x = len(xs), np.array(xs, dtype=object)
    sums = x.sum(0)
    centred = np.array([[float(Fraction(int(v)) - Fraction(int(s), n)) for v, s in zip(row, sums, strict=True)] for row in xs])
    e, basis = np.linalg.eigh(centred.T @ centred / n)
    e, basis = e[::-1], basis[:, ::-1]
    out = {}
    for i, v in fine:
        off = [n * a - int(s) for a, s in zip(v, sums, strict=True)]
        out[i] = (n, sum(o * o for o in off), (np.array(off, float) / n) @ basis[:, :4] / np.sqrt(e[:4]))
    return out, e[:4] / e.sum()


def compare(got, rows, weighted=False):
    want, shares = brute(rows, weighted)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want)
    sign = None
    for i, comps in by.items():
        n, deviation, w = want[i]
        assert sorted(comps) == [1, 2, 3, 4][: len(comps)]
        have = np.array([comps[k].whitened for k in sorted(comps)])
        sign = np.sign(have * w[: len(have)]) if sign is None else sign
        assert np.allclose(have, w[: len(have)] * np.where(sign == 0, 1, sign), atol=1e-8)
        for k, r in comps.items():
            assert (r.n, int(r.deviation)) == (n, deviation) and abs(r.explained / shares[k - 1] - 1) < 1e-9 and r.identity_error < 1e-9


@pytest.mark.parametrize("weighted", [False, True])
def test_equals_brute(spark, weighted):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(500)] + [(2000, None), (2001, []), (2002, [0.1, None] * 3), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, [-0.0] * 6), (2006, [0.5] * 5), (2007, [1e300] * 6)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, key string, copies int").repartition(5)
    got = wh.whiten_rows(df, weighted=weighted).collect()
    compare(got, [r for r in rows if r[0] < 2006], weighted)


def test_query(spark):
    d = f"{TESTDATA}/sf0.001"
    df = op12_embedding_whitening(spark, d)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(df.collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()])


def test_large_entries(spark):
    """Sums and deviations that no 64 bits hold are exact."""
    rows = [(i, [float(2**40 * (i % 7 - 3)), float(i)]) for i in range(20)]
    got = wh.whiten_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1).collect()
    sums = [sum(int(v[k]) for _, v in rows) for k in range(2)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((20 * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in rows}


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert wh.whiten_rows(spark.createDataFrame([], kind)).collect() == []
    assert wh.whiten_rows(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    assert wh.whiten_rows(spark.createDataFrame([(1, [0.5, 0.25])] * 9, kind)).collect() == []  # no variance, no component
    two = wh.whiten_rows(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.75]), (None, [0.5, 0.75])], kind)).collect()
    assert sorted((str(r.vec_id), r.component, round(abs(r.whitened), 9), r.explained) for r in two) == [("1", 1, 1.0, 1.0), ("2", 1, 1.0, 1.0), ("None", 1, 1.0, 1.0)]
