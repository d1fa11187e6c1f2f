"""Exact dedup by a tree merge of sorted digest runs.

Every partition of digests is a leaf. It sorts its digests into runs and collapses them, so
a group of copies leaves one entry a run. Then come binomial rounds: in round t, node i and
node i xor 2^t exchange runs, each keeping the entries whose digest has its own t-th bit.
Runs travel as blocks of sorted entries; a node takes blocks by their first digest and
merges all runs that it holds at once, block by block, without sorting entries anew. After
the last round node j holds all entries of the j-th share of the digest space, so no node
ever holds more than its share. An entry is (sha256, byte length, second hash, smallest id,
rows); two entries merge only if all three marks agree, which verifies the smallest id that
is kept at every level.

Defined cases. Null text counts as empty; empty texts are equal to each other. A null
doc_id is larger than any other. Rows repeated with the same doc_id and text all get
the same keep_id, and exactly one of them is kept. Of other columns nothing is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import SPACE, free, stash, texts, tidy

ROWS_A_NODE = 1_000_000
RUN, BLOCK = 200_000, 10_000  # entries sorted at once at a leaf, and sent in a block
HOT_TEXTS = 1000  # texts that have at least this part of all rows are joined by broadcast
BLOCKS = "node int, first binary, entries binary"
MERGED = "sha binary, n_bytes long, mark long, keep_id long, keep_tag long, n long"
ENTRY = np.dtype([("sha", "<u8", 4), ("n_bytes", "<i8"), ("mark", "<i8"), ("id", "<i8"), ("no_id", "?"), ("tag", "<i8"), ("n", "<i8")])
LAST = np.iinfo(np.uint64).max


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, tag (unique per row), sha256 and the two further marks of each row's text."""
    text = F.regexp_replace("text", SPACE, " ")
    return texts(docs).select(
        "doc_id",
        F.monotonically_increasing_id().alias("tag"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("mark"),
    )


def first_word(entries: np.ndarray) -> np.ndarray:
    return entries["sha"][:, 0]


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several, equal entries collapsed to the smallest id and the sum of rows.

    The stable sort of the digests' first words finds the runs and merges them; digests that
    agree in it but differ beyond are put in order by all they have.
    """
    e = np.concatenate(runs)
    if not len(e):
        return e
    key = first_word(e)
    order = np.argsort(key, kind="stable")
    e, key = e[order], key[order]
    same = (e["sha"][1:] == e["sha"][:-1]).all(axis=1) & (e["n_bytes"][1:] == e["n_bytes"][:-1]) & (e["mark"][1:] == e["mark"][:-1])
    if ((key[1:] == key[:-1]) & ~same).any():
        e = e[np.lexsort((e["mark"], e["n_bytes"], *e["sha"].T[::-1]))]
        same = (e["sha"][1:] == e["sha"][:-1]).all(axis=1) & (e["n_bytes"][1:] == e["n_bytes"][:-1]) & (e["mark"][1:] == e["mark"][:-1])
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(begin, len(e)))
    rank = np.where(e["no_id"], LAST, e["id"].astype(np.uint64) ^ np.uint64(1 << 63))
    least = np.repeat(np.minimum.reduceat(rank, begin), size)
    tag = np.where(rank == least, e["tag"], np.iinfo(np.int64).max)
    first = np.flatnonzero(tag == np.repeat(np.minimum.reduceat(tag, begin), size))
    out = e[first]  # tags are unique, so one of each group
    out["n"] = np.add.reduceat(e["n"], begin)
    return out


def dealt(run: np.ndarray, node: int, bit: int | None) -> Iterator[pa.RecordBatch]:
    """A run as blocks for the two nodes that differ in this bit; None: for this node."""
    own = np.full(len(run), node) if bit is None else node & ~bit | (run["sha"][:, 3].astype(np.int64) & bit)
    for to in np.unique(own).tolist():
        part = run[own == to]
        rows = [(to, part[k]["sha"].astype(">u8").tobytes(), part[k : k + BLOCK].tobytes()) for k in range(0, len(part), BLOCK)]
        nodes, first, blocks = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array(first, pa.binary()), pa.array(blocks, pa.binary())], ["node", "first", "entries"])


def leaf_runs(rows: DataFrame, leaves: int) -> DataFrame:
    """The sorted runs of each partition of `digests`, dealt for the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, waiting, held = TaskContext.get().partitionId() % leaves, [], 0
        for b in batches:
            e = np.zeros(b.num_rows, ENTRY)
            e["sha"] = np.frombuffer(b"".join(b.column("sha").to_pylist()), ">u8").reshape(-1, 4)
            for name, column in (("n_bytes", "n_bytes"), ("mark", "mark"), ("tag", "tag")):
                e[name] = b.column(column).to_numpy()
            e["id"], e["no_id"], e["n"] = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False), 1
            waiting.append(e)
            held += len(e)
            if held >= RUN:
                yield from dealt(merge(waiting), node, 1)
                waiting, held = [], 0
        if waiting:
            yield from dealt(merge(waiting), node, 1)

    return rows.select("doc_id", "tag", "sha", "n_bytes", "mark").mapInArrow(tidy(run), BLOCKS)


def merged(blocks: Iterator[tuple[bytes, bytes]]) -> Iterator[np.ndarray]:
    """The sorted, collapsed entries of blocks that come by their first digests.

    What lies before the first digest of the next block is complete; the rest waits.
    """
    waiting: list[np.ndarray] = []
    held = 0
    for first, block in blocks:
        if held >= 4 * BLOCK:
            run = merge(waiting)
            ready = int(np.searchsorted(first_word(run), np.uint64(int.from_bytes(first[:8], "big"))))
            if ready:
                yield run[:ready]
            waiting, held = [run[ready:]], len(run) - ready
        waiting.append(np.frombuffer(block, ENTRY))
        held += len(waiting[-1])
    if held:
        yield merge(waiting)


def exchange(blocks: DataFrame, leaves: int, following: int | None) -> DataFrame:
    """A round: every node merges the runs that it gets, and deals the outcome by the following round's bit, or as columns after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = -1

        def blocks() -> Iterator[tuple[bytes, bytes]]:
            nonlocal node
            for b in batches:
                for node, first, entries in zip(*(b.column(c).to_pylist() for c in ("node", "first", "entries")), strict=True):
                    yield first, entries

        for e in merged(blocks()):
            if following is not None:
                yield from dealt(e, node, following)
            else:
                sha = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(e), [None, pa.py_buffer(e["sha"].astype(">u8").tobytes())]).cast(pa.binary())
                columns = [sha, pa.array(e["n_bytes"]), pa.array(e["mark"]), pa.array(e["id"], mask=e["no_id"]), pa.array(e["tag"]), pa.array(e["n"])]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in MERGED.split(", ")])

    return blocks.repartitionById(leaves, F.col("node")).sortWithinPartitions("first").mapInArrow(tidy(run), BLOCKS if following is not None else MERGED)


def merge_runs(rows: DataFrame, rows_a_node: int = ROWS_A_NODE) -> DataFrame:
    """One entry for each different text among `rows` (of `digests`), by rounds of exchange between pairs of nodes; two rounds at least."""
    leaves, rounds = 4, 2
    while leaves * rows_a_node < rows.count() or leaves < rows.rdd.getNumPartitions():
        leaves, rounds = leaves * 2, rounds + 1
    runs = leaf_runs(rows, leaves)
    for t in range(rounds):
        runs = exchange(runs, leaves, 1 << (t + 1) if t + 1 < rounds else None)
    return runs


def decisions(docs: DataFrame) -> DataFrame:
    """A row per row of `docs`: doc_id, sha, keep_id, group_size and kept.

    Texts with a HOT_TEXTS-th of all rows or more, which are HOT_TEXTS at most, are joined by
    broadcast, so that no task of the other join gets more rows of one text than that.
    """
    rows = stash(digests(docs), "digests")
    kept = stash(merge_runs(rows), "merged")
    marks = ["sha", "n_bytes", "mark"]
    often = F.col("n") * HOT_TEXTS >= max(1, rows.count())
    out = ["doc_id", "sha", "keep_id", F.col("n").alias("group_size"), (F.col("tag") == F.col("keep_tag")).alias("kept")]
    hot = F.broadcast(kept.filter(often))
    return rows.join(hot, marks).select(*out).unionByName(rows.join(hot, marks, "left_anti").join(kept.filter(~often), marks).select(*out))


def keep_ids(docs: DataFrame) -> DataFrame:
    """The query's form of `decisions`, with the digest in hexadecimal."""
    return decisions(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts, with all their columns.

    A row stays if its doc_id and text are those of a kept row; where that leaves rows
    repeated under one id, one of them stays.
    """
    kept_id, kept_sha, size, mark = map(free, ("id", "sha", "size", "mark"))
    kept = decisions(docs).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("sha").alias(kept_sha), F.col("group_size").alias(size))
    kept = stash(kept, "kept")
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " ")
    rows = docs.withColumn(mark, F.unhex(F.sha2(text, 256)))
    same = F.col("doc_id").eqNullSafe(F.col(kept_id))
    on = same & (F.col(mark) == F.col(kept_sha))
    single, several = kept.filter(F.col(size) == 1), kept.filter(F.col(size) > 1)
    ids = docs.select("doc_id").join(several, same, "left_semi")
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.join(kept, on, "left_semi").drop(mark)
    found = rows.join(several, on, "left_semi").dropDuplicates(["doc_id", mark])
    return rows.join(single, on, "left_semi").unionByName(found).drop(mark)
