import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from slotline.llm import ngram_table as nt
from slotline.llm import resampling as rs
from slotline.llm.queries import op11_importance_resampling
from tests.conftest import TESTDATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, order=2):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target):
    """What the operator is to return, row by row."""
    each = [(i, *features(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in each for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10_000)}
    rows = []
    for i, n_words, fs in each:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = able[: len(able) * 25 // 100]
    return sorted([(r[0], *r[2:], k + 1) for k, r in enumerate(drawn)] + [(r[0], *r[2:], None) for r in [*able[len(drawn) :], *(r for r in rows if r[1] < 20)]], key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_keys_and_crc(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 2000)
    length = np.where(rng.random(2000) < 0.9, rng.integers(1, 40, 2000), rng.integers(1, 900, 2000))
    spans = nt.Spans(data)
    parts = [data[a : a + n].tobytes() for a, n in zip(start, length, strict=True)]
    assert spans.keys(start, length).tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    assert spans.crc32(start, length).tolist() == [zlib.crc32(p) for p in parts]


@pytest.mark.parametrize("same_keys", [False, True])
def test_table_verifies_bytes(same_keys):
    """Also when all keys are equal, only equal bytes share a slot."""
    words = [b"a", b"b", b"ab", b"abcdefgh1", b"abcdefgh2", b"a", b"abcdefgh1", b"b", b"a"] * 5
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    t = nt.Table(nt.Spans(data), start, length, 10_000, np.zeros(len(words), np.uint64) if same_keys else None)
    by = {}
    for w, s in zip(words, t.slot.tolist(), strict=True):
        assert by.setdefault(w, s) == s
    assert len(set(by.values())) == len(by) == len(t.used)
    assert {w: int(t.count[s]) for w, s in by.items()} == Counter(words)
    assert all(t.bucket[s] == zlib.crc32(w) % 10_000 for w, s in by.items())


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("most", [7, 64, 1 << 20])
def test_pieces_lose_no_ngram(order, most, monkeypatch):
    texts = ["", "one", "a b c", "   ", "x" * 50 + " y", "p" + " " * 40 + "q r " + "-" * 30 + "s", "É ß 1A-b", "tail " * 30]
    monkeypatch.setattr(nt, "BLOCK", 5)
    whole = nt.pieces
    monkeypatch.setattr(nt, "pieces", lambda raw, cuts, again: whole(raw, cuts, again, most))
    total, words = [Counter() for _ in texts], np.zeros(len(texts), int)
    for first, last, t, text, n_words in nt.tables(pa.array(texts), order, 10_000):
        words[first:last] += n_words
        for d, s in zip(text.tolist(), t.slot.tolist(), strict=True):
            total[first + d][int(t.bucket[s])] += 1
    for k, t in enumerate(texts):
        n, fs = features(t, order)
        assert words[k] == n and total[k] == Counter(map(bucket, fs))


def test_equals_brute(spark):
    d = f"{TESTDATA}/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert got(op11_importance_resampling(spark, d)) == want
    assert sum(r[4] is not None for r in want) > 10


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(1, "lorem ipsum dolor"), (2, None), (3, "")], "item_id long, text string")
    more = odd_docs.unionByName(odd_docs)
    assert got(rs.resample(more, target)) == brute([(r.doc_id, r.text) for r in more.collect()], ["lorem ipsum dolor"])
    assert got(rs.resample(odd_docs, target.limit(0))) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], [])
    assert got(rs.resample(no_docs, target)) == []


def test_draw_follows_the_target(spark):
    near, far = "alpha beta gamma delta " * 6, "one two three four " * 6
    docs = spark.createDataFrame([(i, near if i % 4 == 0 else far) for i in range(4000)], "doc_id long, text string")
    target = spark.createDataFrame([(i, near) for i in range(200)], "item_id long, text string")
    drawn = rs.resample(docs, target).filter("rank is not null")
    assert drawn.count() == 1000 and drawn.filter("doc_id % 4 = 0").count() > 900
