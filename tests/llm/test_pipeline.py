"""The pipeline against its stages' brute-force parts, and its guard."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as cp
from slotline.llm import packing
from slotline.llm.common import stash
from tests.conftest import TESTDATA
from tests.llm.test_exact_dedup import norm
from tests.llm.test_ngram_join import brute

SF = f"{TESTDATA}/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, seen = docs, {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, left, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        seen[name] = [(r.doc_id, r.text) for r in left.select("doc_id", "text").orderBy("doc_id").collect()]
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert seen["language_id"] == [r for r in rows if any(c.isalpha() for c in r[1])]
    first = {}
    for i, t in seen["language_id"]:
        first.setdefault(norm(t), (i, t))
    assert seen["exact_dedup"] == sorted(first.values())
    least = {i for i, _, c in brute(seen["exact_dedup"]) if i == c}
    assert seen["ngram_join"] == [r for r in seen["exact_dedup"] if r[0] in least]
    assert {i for i, _ in seen["mixing"]} <= least and len(seen["mixing"]) > 0.8 * len(least)
    w = packing.words(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter()
    for r in cp.STAGES[-1][1](spark, left, SF).collect():
        got[r.doc_id] += r.length
    want = Counter()
    for i, t in seen["mixing"]:
        want[i] += len(np.frombuffer(w.of(t), "<u4")) + 1
    assert got == want


@pytest.fixture()
def folder(spark, tmp_path, odd_docs, no_docs, odd_labels, no_labels):
    def write(name, docs, labels):
        for table, df in (("documents", docs), ("labels", labels)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        return f"{tmp_path}/{name}"

    return {"empty": write("empty", no_docs, no_labels), "odd": write("odd", odd_docs.unionByName(odd_docs), odd_labels)}


def test_empty_tables(spark, folder):
    assert cp.run(spark, folder["empty"]).count() == 0


def test_odd_rows(spark, folder, odd_docs):
    """Nulls, repeated rows, long texts and clashing columns through every stage and through `run`."""
    docs = spark.read.parquet(f"{folder['odd']}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder["odd"])
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = stash(out, name)
    texts = {norm(r.text) for r in docs.select("text").collect()}
    assert "" not in texts and texts <= {norm(r.text) for r in odd_docs.select("text").collect()}
    pieces = cp.run(spark, folder["odd"]).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
