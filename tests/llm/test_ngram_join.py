import random

import numpy as np
import pytest

from slotline.llm import ngram_join as nj
from tests.llm.conftest import WORDS


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(1, 3)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    """Groups of copies below and beyond SHORT_LIST, with edits that leave some pairs linked and others not, and a passage that many share."""
    rng = random.Random(seed)
    fresh = lambda n: [rng.choice(WORDS) + str(rng.randrange(2000)) for _ in range(n)]
    rows, passage = [], fresh(60)
    for size in (2, 3, 5, 40, 60):
        base = fresh(rng.choice([30, 80, 200]))
        rows += [" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 22)))) for _ in range(size)]
    rows += [" ".join([*passage, *fresh(rng.randrange(4, 60))]) for _ in range(60)]
    rows += [" ".join(fresh(rng.randrange(1, 8))) for _ in range(30)] + ["a b c d", "A  b C\nd", "a b c d e", ""]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = nj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_dealt_lists_and_blocks(spark, monkeypatch):
    """Common lists dealt over several parts, large components in blocks of their own, and sets cut into ranges."""
    for name, value in (("ROWS_A_LIST", 5), ("BLOCK", 8), ("CELL", 2), ("ROUNDS", 1), ("WHOLE", 60)):
        monkeypatch.setattr(nj, name, value)
    rng = random.Random(11)
    fresh = lambda n: [rng.choice(WORDS) + str(rng.randrange(2000)) for _ in range(n)]
    rows = []
    for size, words in ((70, 90), (50, 55)):
        base = fresh(words)
        rows += [" ".join(edited(rng, base, rng.randrange(0, 5))) for _ in range(size)]
    rows = list(enumerate(rows))
    got = nj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("bits", [3, 8])
def test_coinciding_marks(spark, monkeypatch, bits):
    """Where different shingles of a text get one mark, pairs just similar enough are still found.

    The shingles that a pair shares are common ones, which go last in the order.
    """
    monkeypatch.setattr(nj, "MARK_BITS", bits)
    rng = random.Random(bits)
    fresh = lambda n: [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n)]
    rows = []
    for _ in range(6):
        base = fresh(400)
        for share in (0.84, 0.86, 0.88, 0.9):
            rows.append(" ".join(base[: int(400 * share)] + fresh(400 - int(400 * share))))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    counts = []
    nj_candidates = nj.candidates
    monkeypatch.setattr(nj, "candidates", lambda sent, cuts: (counts.append(sent.filter("fragment < 0").count()), nj_candidates(sent, cuts))[1])
    got = nj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert counts[0] > 0


def test_very_common_text(spark):
    """A text that most rows hold is joined to its component without its rows meeting in one task."""
    rows = [(k, "one two three four five six seven") for k in range(500)] + [(k, f"x{k} y z a b c d e") for k in range(500, 520)] + [(None, "one two three four five six seven")]
    got = nj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in nj.join(odd_docs).collect()), key=str) == brute(rows)
    kept = nj.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").select("doc_id").distinct().collect()) == [1, 3, 4, 5, 6, 8, 9]
    assert nj.join(no_docs).count() == 0 and nj.representatives(no_docs).count() == 0


def test_repeated_rows_in_several_partitions(spark, monkeypatch):
    """A repeated representative, and copies without ids, count once beside pairs of similarity 0.4 to 0.7.

    No shingle stands out here, as in a large input; any order gives the same links.
    """
    monkeypatch.setattr(nj, "ordered", lambda h, level: h >> np.uint64(4))
    rng = random.Random(5)
    fresh = lambda n: [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n)]
    repeated, once = [], []
    for k, same in enumerate((62, 70, 78)):
        base = fresh(100)
        one, two = " ".join(base), " ".join(base[:same] + fresh(100 - same))
        a, b = shingle_set(one), shingle_set(two)
        assert 0.4 < len(a & b) / len(a | b) < 0.7
        back, other = " ".join(base[::-1]), " ".join((base[:same] + fresh(100 - same))[::-1])
        repeated += [(10 * k, one), (None, other)]
        once += [(10 * k + 1, two), (10 * k + 5, back)]
    parts = [repeated + once, repeated, repeated]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(parts, 3).flatMap(lambda p: p), "doc_id long, text string")
    assert docs.rdd.getNumPartitions() == 3
    assert sorted((tuple(r) for r in nj.join(docs).collect()), key=str) == brute([r for p in parts for r in p])


def test_representatives_of_repeated_ids(spark):
    """Of an id that stands for two texts only the row whose text is near a smaller id's goes."""
    one, two = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, one), (2, one + " more"), (2, two), (2, one + " more"), (3, None), (None, one), (4, "x y")]
    kept = nj.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(50)] + [(100 + k, 100) for k in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(90)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.component for r in nj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(root))


def test_prefixes():
    for n in range(1, 300):
        assert nj.core(n) <= nj.prefix(n) <= n
        for m in range(n, 300):
            i = nj.need(n, m)
            assert 175 * i >= 75 * (n + m) > 175 * (i - 1)
            if i <= n:  # sets that are similar enough share one of the first ones
                assert n - i + 1 <= nj.core(n) or n - i + 1 <= nj.prefix(n)
