import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from slotline.llm import exact_dedup as ed


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return groups


@pytest.mark.parametrize("a_node", [1, 9, 1_000_000])
def test_tree_of_any_height(spark, a_node):
    rows = [(k, f"text {k % 7} {k % 3}") for k in range(60)]
    got = ed.merge_runs(ed.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).cache(), a_node).collect()
    want = brute(rows)
    assert {(bytes(r.sha).hex(), r.keep_id, r.n) for r in got} == {(hashlib.sha256(t.encode()).hexdigest(), min(ids), len(ids)) for t, ids in want.items()}


def test_every_level_keeps_the_smallest_id(spark):
    rows = [(100 - k, f"text {k % 5}") for k in range(80)]
    digests = ed.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).cache()
    runs, seen = ed.leaf_runs(digests, 8), []
    for bit in (2, 4, None):
        entries = [e for r in runs.collect() for e in np.frombuffer(r.entries, ed.ENTRY)]
        by = {}
        for e in entries:
            key = e["sha"].astype(">u8").tobytes()
            by[key] = (min(by.get(key, (1000, 0))[0], int(e["id"])), by.get(key, (0, 0))[1] + int(e["n"]))
        seen.append((len(entries), {hashlib.sha256(t.encode()).digest(): (min(ids), len(ids)) for t, ids in brute(rows).items()} == by))
        runs = ed.exchange(runs, 8, bit)
    assert all(same for _, same in seen) and seen[0][0] > seen[1][0] >= seen[2][0] >= runs.count() == 5


def test_merging_blocks_in_streams(monkeypatch):
    """Blocks of many runs that overlap, digests that agree in their first words, and ids that are null."""
    monkeypatch.setattr(ed, "BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = np.zeros(500, ed.ENTRY)
    rows["sha"][:, 0] = rng.integers(0, 40, 500)
    rows["sha"][:, 2] = rng.integers(0, 2, 500)
    rows["id"], rows["no_id"], rows["tag"], rows["n"] = rng.integers(-50, 50, 500), rng.random(500) < 0.3, np.arange(500), 1
    blocks = []
    for part in np.array_split(rows, 11):
        run = ed.merge([part])
        blocks += [(run[k]["sha"].astype(">u8").tobytes(), run[k : k + 4].tobytes()) for k in range(0, len(run), 4)]
    out = np.concatenate(list(ed.merged(iter(sorted(blocks)))))
    want = {}
    for e in rows:
        want.setdefault(tuple(e["sha"].tolist()), []).append((bool(e["no_id"]), 0 if e["no_id"] else int(e["id"]), int(e["tag"])))
    assert [tuple(e["sha"].tolist()) for e in out] == sorted(want)
    for e in out:
        own = want[tuple(e["sha"].tolist())]
        assert e["n"] == len(own) and bool(e["no_id"]) == min(own)[0] and (e["no_id"] or int(e["id"]) == min(own)[1])


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    groups = brute(rows)
    got = ed.keep_ids(odd_docs).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_deduplicate(odd_docs):
    out = ed.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns
    rows = [norm(r.text) for r in out.collect()]
    assert len(rows) == len(set(rows)) == len({norm(r.text) for r in odd_docs.collect()})


def test_empty(no_docs):
    assert ed.keep_ids(no_docs).count() == 0 and ed.deduplicate(no_docs).count() == 0
