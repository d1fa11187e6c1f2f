"""N-gram Jaccard join by vertical partitioning.

A text's set is its distinct SHINGLE-word shingles, as 64-bit hashes in one global order:
shingles that many texts hold go last, as a fixed-size count of hash buckets over all texts
tells, and then by hash. Any order gives the same links; this one keeps lists short.

1. Texts with equal sets are one class; a class is named by two 64-bit sums over its set.
2. The global order is cut into fragments, ranges of the order that hold about equally many
   of the shingles needed. Each class sends a fragment those of its first shingles there
   that two sets as similar as asked for must share (prefix filter). Every fragment lists,
   for each shingle, its classes by size, and counts the partial overlaps of all pairs of
   its short lists; of a long list it names the pairs along a binomial tree and keeps the
   list itself for step 5. Lists of very common shingles are dealt over several fragments
   and count as long. Summed over fragments, the partial overlaps bound what a pair can
   share, and only pairs that may reach the similarity go on.
3. Candidates are decided by their whole sets; large sets are cut into VERTICAL ranges of
   the hashes, whose overlaps are counted separately and summed per pair.
4. Components of the links, by alternating large and small stars.
5. A long list may still hold pairs across components. Pairs within small random cells of
   it are decided first, which joins most of what can be joined. What is left is searched in
   blocks: a list's classes are dealt into blocks of about BLOCK, large components into
   blocks of their own; two blocks meet unless both are of one component. A meeting works
   on sizes and counts of shared lists alone and emits only pairs across components that may
   be similar enough, each in the largest of the lists that tell. Pairs within one
   component can't change any component, so no pair that matters is left unseen.

Defined cases. Words are runs between ASCII white space, A-Z lowered. With fewer than
SHINGLE words the whole sequence is the only shingle; null, empty and blank texts have an
empty set and are their own component. Rows with a null doc_id link like others; a component
of only such rows has a null component_id. Repeated rows are one class; each is returned. Of
other columns nothing is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import Scratch, free, left_join, partitions, small_batches, stash, texts, tidy
from slotline.llm.words import U, chunks, mix

SHINGLE, PERCENT = 5, 75
BUCKETS, RANGES, BINS = 1 << 22, 64, 1 << 10
ROWS_A_FRAGMENT, ROWS_A_LIST = 1_000_000, 200_000
SHORT_LIST = 12
WHOLE, VERTICAL = 8192, 16  # larger sets are compared in so many ranges
ROUNDS, CELL, BLOCK, TOPS = 3, 16, 1024, 4
BLOOM_BITS = 1 << 27  # at most
MARK_BITS = 32  # a shingle's mark within its fragment; at most 32

_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)
_CORE, _SPLIT, _ROW = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingle_sets(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts `first` to `last` (without it): the sorted distinct hashes of each one's shingles side by side, and where each begins and the last ends."""
    for first, last, w, at in chunks(text):
        n = len(w) - SHINGLE + 1
        if n > 0:
            h = w[:n] * _PLACE[0]
            for k in range(1, SHINGLE):
                h += w[k : k + n] * _PLACE[k]
            h = mix(h)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                sets.append(distinct(h[a : b - SHINGLE + 1]))
            else:
                sets.append(mix((w[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=U) + U(b - a)) if b > a else w[:0])
        yield first, last, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def sums(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The wrapping sum of each set's numbers, as signed longs."""
    return np.diff(np.concatenate([np.zeros(1, U), np.cumsum(h, dtype=U)])[cuts]).astype(np.int64)


def names(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that name its class."""
    return sums(mix(h, 0x94D049BB133111EB), cuts), sums(mix(h ^ U(0x5851F42D4C957F2D), 0xDA942042E4DD58B5), cuts)


def need(a: int, b: int) -> int:
    """Smallest overlap of sets of sizes a and b that are similar enough."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix(n: int) -> int:
    """How many first shingles a set of size n must share one of with a smaller similar set."""
    return n - -(-PERCENT * n // 100) + 1


def core(n: int) -> int:
    """The same, towards sets that are no smaller."""
    return n - need(n, n) + 1


def _batch(**columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], list(columns))


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U(32)).astype(np.int32) & (BUCKETS - 1)


def places(cuts: np.ndarray) -> np.ndarray:
    """The place of each number in its own set."""
    return np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))


def profiles(docs: DataFrame) -> DataFrame:
    """A row per text (doc_id, its mark, n, m1, m2), and rows per task (range, places, counts): bucket counts by
    range, and last, where in the range of hashes the first shingles of its sets lie.

    A task's count of a bucket stops at 255; its tasks' counts are summed without a bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bins = np.zeros(BUCKETS, np.uint32), np.zeros(BINS, np.int64)

        def counts(r: int, at: bytes | None, c: bytes) -> pa.RecordBatch:
            none = ([None], pa.int64())
            return _batch(doc_id=none, mark=none, n=none, m1=none, m2=none, range=([r], pa.int32()), places=([at], pa.binary()), counts=([c], pa.binary()))

        for b in batches:
            for first, last, h, cuts in shingle_sets(b.column("text")):
                n = np.diff(cuts)
                np.add.at(total, buckets(h), 1)
                bins += np.bincount((h[places(cuts) < np.repeat(prefix(n), n)] >> U(54)).astype(np.int64), minlength=BINS)
                m1, m2 = names(h, cuts)
                none = [None] * len(n)
                own = {c: (b.column(c).slice(first, last - first), pa.int64()) for c in ("doc_id", "mark")}
                yield _batch(**own, n=(n, pa.int64()), m1=(m1, pa.int64()), m2=(m2, pa.int64()), range=(none, pa.int32()), places=(none, pa.binary()), counts=(none, pa.binary()))
        for r, part in enumerate(np.split(np.minimum(total, 255).astype(np.uint8), RANGES)):
            met = np.flatnonzero(part)
            if len(met) >= len(part) // 8:
                yield counts(r, None, part.tobytes())
            elif len(met):  # of a thinly filled range only the buckets met
                yield counts(r, met.astype(np.uint32).tobytes(), part[met].tobytes())
        if bins.any():
            yield counts(RANGES, None, bins.tobytes())

    rows = texts(docs).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, mark long, n long, m1 long, m2 long, range int, places binary, counts binary")


def levels(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each bucket's count is above what chance makes of the mean, in powers of two (BUCKETS bytes at
    every size); about how many rows a bucket of each such level counts; and where first shingles lie."""
    mean = (counted.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    unit = 5 * np.sqrt(mean) + 3

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for r, at, c in zip(*(b.column(x).to_pylist() for x in ("range", "places", "counts")), strict=True):
                total = totals.setdefault(r, np.zeros(BINS if r == RANGES else BUCKETS // RANGES, np.int64))
                total[slice(None) if at is None else np.frombuffer(at, np.uint32)] += np.frombuffer(c, np.int64 if r == RANGES else np.uint8)
        for r, total in totals.items():
            over = (total - mean) / unit
            level = np.where(over >= 1, np.minimum(15, 1 + np.log2(np.maximum(over, 1))), 0).astype(np.uint8)
            yield _batch(range=([r], pa.int32()), levels=([(total if r == RANGES else level).tobytes()], pa.binary()))

    rows = counted.filter("range is not null").select("range", "places", "counts").repartitionById(RANGES + 1, F.col("range")).mapInArrow(add, "range int, levels binary").collect()
    out, bins = np.zeros((RANGES, BUCKETS // RANGES), np.uint8), np.zeros(BINS, np.int64)
    for r in rows:
        if r.range == RANGES:
            bins = np.frombuffer(r.levels, np.int64)
        else:
            out[r.range] = np.frombuffer(r.levels, np.uint8)
    return out.ravel(), np.concatenate([[0.0], mean + unit * 2.0 ** np.arange(1, 16)]), bins


def ordered(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Keys of the global order: the level, then the hash."""
    return level[buckets(h)].astype(U) << U(60) | h >> U(4)


@dataclass
class Cuts:
    """The fragments of the global order: where each begins, and by how many bits a key's distance from there is cut to a mark."""

    low: np.ndarray
    shift: np.ndarray
    spread: np.ndarray  # over how many parts the lists of a level are dealt
    parts: int  # fragments, and room for the dealt lists

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = np.searchsorted(self.low, key, "right") - 1
        return f, ((key - self.low[f]) >> self.shift[f]).astype(np.uint32)

    def key(self, f: int, mark: np.ndarray) -> np.ndarray:
        """What is known of a mark's key, as a signed long."""
        return (self.low[f] + (mark.astype(U) << self.shift[f])).astype(np.int64)

    def part(self, f: np.ndarray, level: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Where a key of fragment f goes; of a dealt list, by the class's name."""
        n = self.spread[level]
        dealt = by.astype(U) % n
        room = U(max(1, self.parts - len(self.low)))
        return np.where(n > 1, len(self.low) + ((f.astype(U) * U(7919) + dealt) % room).astype(np.int64), f)


def cut(bins: np.ndarray, fragments: int, rows: np.ndarray, rows_a_list: int) -> Cuts:
    """About `fragments` ranges of keys of level 0 with equally many first shingles, and a few for each further level."""
    share = np.concatenate([[0], np.cumsum(bins)]) / max(1, bins.sum())
    inner = np.interp(np.arange(1, fragments) / fragments, share, np.arange(BINS + 1) / BINS)
    low = [0, *(inner * (1 << 60)).astype(np.int64).tolist()]
    few = max(1, fragments // 32)
    low += [(level << 60) + (k << 60) // few for level in range(1, 16) for k in range(few)]
    low = np.unique(np.array(low, U))
    width = np.diff(np.append(low, np.iinfo(U).max))
    shift = np.array([max(0, int(w).bit_length() - MARK_BITS) for w in width], U)
    spread = np.maximum(1, np.ceil(rows / rows_a_list)).astype(U)
    return Cuts(low, shift, spread, len(low) + (fragments if (spread > 1).any() else 0))


def signatures(docs: DataFrame, level: np.ndarray, cuts: Cuts) -> DataFrame:
    """For each task, part and fragment: its classes (name and size) and their first shingles there.

    Different shingles of one class may get the same mark. How many do, which is none for most
    classes, is sent as a row of its own: what two classes share is counted short by no more
    than the smaller of their numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        classes: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table, n = np.concatenate(classes), np.array([len(k) for k in keys])
            of, k = np.repeat(np.arange(len(keys)), n), np.concatenate(keys)
            at = places(np.concatenate([[0], np.cumsum(n)]))
            f, mark = cuts.of(k)
            lv = (k >> U(60)).astype(np.int64)
            place = np.lexsort((mark, f, of))
            again = (of[place][1:] == of[place][:-1]) & (f[place][1:] == f[place][:-1]) & (mark[place][1:] == mark[place][:-1])
            met = np.bincount(of[place][1:][again], minlength=len(keys))
            if met.any():
                own = np.flatnonzero(met)
                yield _batch(part=([0], pa.int32()), fragment=([-1], pa.int32()), classes=([np.column_stack([table[own, :2], met[own]]).tobytes()], pa.binary()), marks=([b""], pa.binary()), rows=([b""], pa.binary()))
            part = cuts.part(f, lv, table[of, 0])
            row = of.astype(np.uint32) | np.where(at < core(table[of, 2]), _CORE, np.uint32(0)) | np.where(cuts.spread[lv] > 1, _SPLIT, np.uint32(0))
            to = part << 32 | f
            order = np.argsort(to, kind="stable")
            bounds = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = order[a:b]
                met, index = np.unique(of[own], return_inverse=True)
                rows = index.astype(np.uint32) | row[own] & ~_ROW
                p = int(to[own[0]])
                yield _batch(part=([p >> 32], pa.int32()), fragment=([p & 0xFFFFFFFF], pa.int32()), classes=([table[met].tobytes()], pa.binary()), marks=([mark[own].tobytes()], pa.binary()), rows=([rows.tobytes()], pa.binary()))

        for b in batches:
            for _, _, h, at in shingle_sets(b.column("text")):
                n, (m1, m2), key = np.diff(at), names(h, at), ordered(h, level)
                table = np.stack([m1, m2, n], axis=1)
                for k, m in enumerate(zip(m1.tolist(), m2.tolist(), strict=True)):
                    if n[k] == 0 or m in seen:
                        continue
                    seen.add(m)
                    classes.append(table[k : k + 1])
                    keys.append(np.sort(key[at[k] : at[k + 1]])[: prefix(int(n[k]))])
                    held += len(keys[-1])
                if held >= 500_000:
                    yield from flush()
                    classes, keys, held = [], [], 0
        if keys:
            yield from flush()

    return texts(docs).select("text").mapInArrow(tidy(run), "part int, fragment int, classes binary, marks binary, rows binary")


def list_pairs(size: np.ndarray, mark: np.ndarray, cls: np.ndarray, is_core: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of short lists (as indices into cls, smaller set first) with how many lists they share and
    whether one is in the smaller set's core; pairs along long lists' trees; which rows are in long lists.

    Rows come sorted by mark, then by size and class; cls is a class's place in that order.
    """
    n = len(mark)
    begin = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
    length = np.diff(np.append(begin, n))
    start, many = np.repeat(begin, length), np.repeat(length, length)
    at = np.arange(n) - start
    is_long = (many > SHORT_LIST) | split
    short, in_core, tree = [], [], []
    for d in range(1, SHORT_LIST):
        b = np.flatnonzero(~is_long & (at >= d))
        b = b[100 * size[b - d] >= PERCENT * size[b]]
        short.append(cls[b - d] << 32 | cls[b])
        in_core.append(is_core[b - d])
    b = np.flatnonzero(is_long & (at > 0))
    for a in (b - 1, start[b] + (at[b] & (at[b] - 1))):
        ok = is_core[a] & (100 * size[a] >= PERCENT * size[b])
        tree.append(cls[a[ok]] << 32 | cls[b[ok]])
    pairs, place, count = np.unique(np.concatenate(short), return_inverse=True, return_counts=True)
    core_too = np.bincount(place, weights=np.concatenate(in_core), minlength=len(pairs)) > 0
    return pairs, count, core_too, np.unique(np.concatenate(tree)), is_long


CANDIDATES = "kind int, a1 long, a2 long, b1 long, b2 long, shared long, list long, core boolean"


def candidates(sent: DataFrame, cuts: Cuts) -> DataFrame:
    """Of each fragment: pairs (kind 0: names a and b, lists shared, core), members of long lists
    (kind 1: name a, list, core) and pairs along the trees of long lists (kind 2: names a and b);
    and classes whose own marks coincide (kind 3: name a, shared: how many)."""

    def batch(kind: int, one: np.ndarray, two: np.ndarray | None, count: np.ndarray | None, number: np.ndarray | None, flag: np.ndarray | None) -> pa.RecordBatch:
        none = [None] * len(one)
        b1, b2 = (none, none) if two is None else (two[:, 0], two[:, 1])
        return _batch(kind=([kind] * len(one), pa.int32()), a1=(one[:, 0], pa.int64()), a2=(one[:, 1], pa.int64()), b1=(b1, pa.int64()), b2=(b2, pa.int64()),
                      shared=(none if count is None else count, pa.int64()), list=(none if number is None else number, pa.int64()), core=(none if flag is None else flag, pa.bool_()))

    def of(fragment: int, sent: list[tuple]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(t, np.int64).reshape(-1, 3) for t, _, _ in sent]
        base = np.concatenate([[0], np.cumsum([len(t) for t in tables])])
        table, mark = np.concatenate(tables), np.concatenate([np.frombuffer(m, np.uint32) for _, m, _ in sent])
        row = [np.frombuffer(r, np.uint32) for _, _, r in sent]
        cls = np.concatenate([(r & _ROW).astype(np.int64) + k for r, k in zip(row, base, strict=False)])
        row = np.concatenate(row)
        is_core, split = (row & _CORE) > 0, (row & _SPLIT) > 0
        rank = np.lexsort((table[:, 1], table[:, 0], table[:, 2]))  # by size, then name; equal names side by side
        own = table[rank]
        number = np.concatenate([[0], np.cumsum((own[1:] != own[:-1]).any(axis=1))])
        place = np.empty(len(table), np.int64)
        place[rank] = number
        own = own[np.concatenate([[True], number[1:] != number[:-1]])]
        cls = place[cls]
        order = np.lexsort((~is_core, cls, mark))
        mark, cls, is_core, split = mark[order], cls[order], is_core[order], split[order]
        keep = np.concatenate([[True], (mark[1:] != mark[:-1]) | (cls[1:] != cls[:-1])])
        mark, cls, is_core, split = mark[keep], cls[keep], is_core[keep], split[keep]
        pairs, shared, core_too, tree, long = list_pairs(own[cls, 2], mark, cls, is_core, split)
        for k in range(0, len(pairs), 50_000):
            p = pairs[k : k + 50_000]
            yield batch(0, own[p >> 32], own[p & 0xFFFFFFFF], shared[k : k + 50_000], None, core_too[k : k + 50_000])
        for k in range(0, len(tree), 50_000):
            p = tree[k : k + 50_000]
            yield batch(2, own[p >> 32], own[p & 0xFFFFFFFF], None, None, None)
        rows = np.flatnonzero(long)
        for k in range(0, len(rows), 50_000):
            i = rows[k : k + 50_000]
            yield batch(1, own[cls[i]], None, None, cuts.key(fragment, mark[i]), is_core[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple]] = {}
        for b in batches:
            for f, *rest in zip(*(b.column(c).to_pylist() for c in ("fragment", "classes", "marks", "rows")), strict=True):
                if f < 0:
                    table = np.frombuffer(rest[0], np.int64).reshape(-1, 3)
                    yield batch(3, table, None, table[:, 2], None, None)
                else:
                    got.setdefault(f, []).append(tuple(rest))
        while got:
            yield from of(*got.popitem())

    return sent.repartitionById(cuts.parts, F.col("part")).mapInArrow(tidy(run), CANDIDATES)


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(U))
    return np.stack([mix(h + U(i)) & U(bits - 1) for i in range(3)]).astype(np.int64)


def bloom(ids: DataFrame) -> bytes:
    """A filter of the ids in the only column, of 16 bits or more for each, but BLOOM_BITS at most; if it fills up beyond that it only lets more texts through."""
    bits = min(BLOOM_BITS, max(1 << 15, 1 << (16 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(place=(_bloom_places(b.column(0).to_numpy(), bits).ravel(), pa.int64()))

    word = F.shiftright("place", 15)
    found = ids.mapInArrow(tidy(run), "place long").groupBy(word.alias("word")).agg(F.bitmap_construct_agg(F.col("place") % (1 << 15)).alias("bits"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in found.collect():  # BLOOM_BITS at most
        out[r.word] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def sets(docs: DataFrame, wanted: bytes) -> DataFrame:
    """doc_id, m1, m2, form and hashes of the texts whose id the filter knows (or is null).

    Form 0 is the whole set of one of up to WHOLE hashes; forms 1 to VERTICAL are the ranges
    of one that is large, or so large that a similar one may be.
    """

    whole = WHOLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        edges = np.array([(v << 64) // VERTICAL for v in range(1, VERTICAL)], U)
        seen: set[tuple] = set()
        for b in batches:
            ids = b.column("doc_id")
            place = _bloom_places(ids.fill_null(0).to_numpy(), 8 * len(bits))
            known = (bits[place >> 3] >> (place & 7) & 1).all(axis=0) | ids.is_null().to_numpy(zero_copy_only=False)
            part = b.filter(pa.array(known))
            ids = part.column("doc_id").to_pylist()
            for first, _, h, cuts in shingle_sets(part.column("text")):
                out = []
                for k, (a, z, *m) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), *(x.tolist() for x in names(h, cuts)), strict=True)):
                    if a == z or (key := (ids[first + k], *m)) in seen:
                        continue
                    seen.add(key)
                    if z - a <= whole:
                        out.append((*key, 0, h[a:z].tobytes()))
                    if PERCENT * whole < 100 * (z - a):
                        at = [a, *(a + np.searchsorted(h[a:z], edges)).tolist(), z]
                        out += [(*key, v + 1, h[at[v] : at[v + 1]].tobytes()) for v in range(VERTICAL)]
                if out:
                    d, m1, m2, form, x = zip(*out, strict=True)
                    yield _batch(doc_id=(d, pa.int64()), m1=(m1, pa.int64()), m2=(m2, pa.int64()), form=(form, pa.int32()), hashes=(x, pa.binary()))

    return texts(docs).mapInArrow(tidy(run), "doc_id long, m1 long, m2 long, form int, hashes binary")


def whole_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """m1, m2, form and hashes of the classes whose rep_id is the only column of `ids` (and of a few others), each form once.

    A class's representative may be repeated, so that several tasks send its set.
    """
    return sets(docs, bloom(ids.filter(ids[0].isNotNull()))).drop("doc_id").dropDuplicates(["m1", "m2", "form"])


def similar(pairs: DataFrame, mine: DataFrame) -> DataFrame:
    """Of pairs of classes (a, b: class numbers; a1, a2, b1, b2: names; n_a, n_b: sizes) those that are similar enough.

    `mine` has their sets (of `whole_sets`). A set is sent to its name's task once; there the
    exchange serves for both sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, U), np.frombuffer(y, U)]))
                shared.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("sizes"), pa.array(shared, pa.int64())], ["a", "b", "sizes", "shared"])

    forms = F.when(F.greatest("n_a", "n_b") <= WHOLE, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.lit(VERTICAL)))
    both = pairs.select("a", "b", "a1", "a2", "b1", "b2", (F.col("n_a") + F.col("n_b")).alias("sizes"), F.explode(forms).alias("form"))
    for s in "ab":
        both = both.join(mine.toDF(f"{s}1", f"{s}2", "form", f"h{s}"), [f"{s}1", f"{s}2", "form"])
    total = both.select("a", "b", "sizes", "ha", "hb").mapInArrow(tidy(run), "a long, b long, sizes long, shared long").groupBy("a", "b", "sizes").agg(F.sum("shared").alias("shared"))
    return total.filter((100 + PERCENT) * F.col("shared") >= PERCENT * F.col("sizes")).select("a", "b")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node and component (its smallest node) for all nodes of `edges` (a, b) but the smallest ones themselves, by alternating stars."""
    scratch = scratch or Scratch(edges.sparkSession, "components")

    def ends(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stars(e: DataFrame) -> bool:
        """Whether each node points to one other that points to none."""
        ways = e.select(F.col("a").alias("node"), F.lit(1).alias("out")).union(e.select(F.col("b").alias("node"), F.lit(0).alias("out")))
        ways = ways.groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("all"))
        return ways.filter((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("all") > 1))).isEmpty()

    e = scratch.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not stars(e):
        both = ends(e)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        e = scratch.put(small, "stars")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def possible(shared: Column) -> Column:
    """Whether sets a and b that share so many of their first shingles, or as many more as marks of theirs coincide (d_a, d_b), may be similar enough."""
    most = F.greatest("n_a", "n_b")
    needed = F.ceil(PERCENT * (F.col("n_a") + F.col("n_b")) / F.lit(100 + PERCENT))
    return shared + F.least("d_a", "d_b") >= needed - (F.ceil(PERCENT * most / 100) - 1)


NONE = np.iinfo(np.int64).min  # no list
MEMBER = ["a", "n_a", "core", "k", "s", "d", "c", "tops", "core_tops"]


def block_pairs(x: dict[str, np.ndarray], y: dict[str, np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which classes of blocks x and y of a list may be similar enough, are in different components, and are told by no larger list."""
    column = lambda name: x[name][:, None]
    na, nb = column("n_a"), y["n_a"]
    smaller, larger = np.minimum(na, nb), np.maximum(na, nb)
    first = (na < nb) | ((na == nb) & (column("a") < y["a"]))
    ok = (column("c") != y["c"]) & (100 * smaller >= PERCENT * larger) & np.where(first, column("core"), y["core"])
    shared = np.minimum(column("k"), y["k"]) + np.minimum(column("s"), y["s"])
    shared = shared + np.minimum(column("d"), y["d"])
    ok &= shared >= need(na, nb) - (-(-PERCENT * larger // 100) - 1)
    if same:
        ok &= column("a") < y["a"]
    i, j = np.nonzero(ok)
    first = first[i, j]
    told = np.zeros(len(i), bool)  # by a larger list, in which the smaller set has it among its core
    for one, other, way in (("core_tops", "tops", first), ("tops", "core_tops", ~first)):
        a, b = x[one][i], y[other][j]
        for k in range(TOPS):
            told |= way & ((a[:, k : k + 1] == b) & (b != NONE)).any(axis=1)
    return i[~told], j[~told]


def larger_lists(tops: list[list[int]], core: list[list[bool]], than: int) -> dict[str, np.ndarray]:
    """Of each class's largest lists, largest first, those before this one; and of these those that have it among its core."""
    lists = np.array([x + [NONE] * (TOPS - len(x)) for x in tops], np.int64).reshape(-1, TOPS)
    own = np.array([x + [False] * (TOPS - len(x)) for x in core], bool).reshape(-1, TOPS)
    lists[np.maximum.accumulate(lists == than, axis=1)] = NONE
    return {"tops": lists, "core_tops": np.where(own, lists, NONE)}


def meetings(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) that may be similar enough across components, for rows (list, size and MEMBER) of long lists."""
    by = rows.groupBy("list", "c").agg(F.count(F.lit(1)).alias("m"))
    big = by.filter(F.col("m") > BLOCK).select("list", "c", F.ceil(F.col("m") / BLOCK).alias("own"))
    rest = by.filter(F.col("m") <= BLOCK).groupBy("list").agg(F.ceil(F.sum("m") / BLOCK).alias("others"))
    dealt = rows.join(big, ["list", "c"], "left").join(rest, "list", "left")
    tag = F.when(F.col("own").isNotNull(), F.col("c")).otherwise(F.lit(-1))
    dealt = dealt.withColumn("tag", tag).withColumn("piece", F.pmod(F.xxhash64("a", "list"), F.coalesce("own", "others")))
    blocks = big.select("list", F.col("c").alias("tag"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("piece"))
    blocks = blocks.union(rest.select("list", F.lit(-1).alias("tag"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("piece")))
    other = blocks.select("list", F.col("tag").alias("tag2"), F.col("piece").alias("piece2"))
    met = blocks.join(other, "list").filter((F.col("tag") < F.col("tag2")) | ((F.col("tag") == -1) & (F.col("tag2") == -1) & (F.col("piece") <= F.col("piece2"))))
    met = met.withColumn("job", F.xxhash64("list", "tag", "piece", "tag2", "piece2"))
    own = (F.col("tag") == F.col("tag2")) & (F.col("piece") == F.col("piece2"))
    left = dealt.join(met.select("list", "tag", "piece", "job", own.alias("alone")), ["list", "tag", "piece"]).withColumn("side", F.lit(0))
    right = dealt.join(met.filter(~own).select("list", F.col("tag2").alias("tag"), F.col("piece2").alias("piece"), "job", F.lit(False).alias("alone")), ["list", "tag", "piece"]).withColumn("side", F.lit(1))
    jobs = left.unionByName(right).select("job", "alone", "side", "list", *MEMBER)

    def run(t: pa.Table) -> pa.Table:
        sides = []
        for s in (0, 1):
            part = t.filter(pc.equal(t["side"], s)).combine_chunks()
            side = {c: part[c].to_numpy() for c in ("a", "n_a", "core", "k", "s", "d", "c")}
            side |= larger_lists(part["tops"].to_pylist(), part["core_tops"].to_pylist(), t["list"][0].as_py())
            sides.append(side)
        alone = t["alone"][0].as_py()
        x, y = sides[0], sides[0] if alone else sides[1]
        found: list[list[np.ndarray]] = [[], [], [], []]
        for k in range(0, len(x["a"]), 256):
            few = {c: v[k : k + 256] for c, v in x.items()}
            i, j = block_pairs(few, y, alone)
            for f, v in zip(found, (few["a"][i], y["a"][j], few["n_a"][i], y["n_a"][j]), strict=True):
                f.append(v)
        return pa.table([pa.array(np.concatenate(f) if f else [], pa.int64()) for f in found], ["a", "b", "n_a", "n_b"])

    return jobs.groupBy("job").applyInArrow(run, "a long, b long, n_a long, n_b long").distinct()


def join(docs: DataFrame) -> DataFrame:
    """The query's form of `members`: doc_id, n_shingles, component_id."""
    return members(docs).select("doc_id", "n_shingles", "component_id")


def members(docs: DataFrame) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_shingles and component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram_join")
    counted = scratch.put(profiles(docs), "profiles")
    rows = counted.filter("n is not null").select("doc_id", "mark", "n", "m1", "m2")
    level, common, bins = levels(counted)
    classes = rows.filter("n > 0").groupBy("n", "m1", "m2").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total, n_texts = (x or 0 for x in classes.agg(F.sum("n"), F.sum("copies")).first())
    cuts = cut(bins, max(partitions(spark), -(-total // (4 * ROWS_A_FRAGMENT))), common, ROWS_A_LIST)
    found = scratch.put(candidates(signatures(docs, level, cuts), cuts), "candidates")
    ids = classes.select("m1", "m2", "cid", "n")

    def numbered(df: DataFrame, *sides: str) -> DataFrame:
        for s in sides:
            df = df.join(ids.select(F.col("m1").alias(f"{s}1"), F.col("m2").alias(f"{s}2"), F.col("cid").alias(s), F.col("n").alias(f"n_{s}")), [f"{s}1", f"{s}2"])
        return df

    lists = scratch.put(numbered(found.filter("kind = 1").select("a1", "a2", "list", "core"), "a").groupBy("list", "a", "n_a").agg(F.max("core").alias("core")), "lists")
    in_long = scratch.put(lists.groupBy("a").agg(F.count(F.lit(1)).alias("k")), "long")
    sides = ["a1", "a2", "b1", "b2"]
    met = found.filter("kind = 3")
    some_met = not met.isEmpty()  # of large texts only
    if some_met:
        met = scratch.put(numbered(met.groupBy("a1", "a2").agg(F.max("shared").alias("d")), "a").select("a", "d"), "coinciding")

    def coinciding(df: DataFrame, side: str, name: str) -> DataFrame:
        """How many marks of a class coincide, as a further column."""
        return df.join(met.toDF(side, name), side, "left").fillna(0, [name]) if some_met else df.withColumn(name, F.lit(0).cast("long"))

    short = found.filter("kind in (0, 2)").groupBy(*sides).agg(F.sum("shared").alias("shared"), F.max(F.col("core") | (F.col("kind") == 2)).alias("core"))
    short = numbered(short, "a", "b").withColumn("shared", F.coalesce("shared", F.lit(0)))
    short = short.join(in_long.withColumnRenamed("k", "k_a"), "a", "left").join(in_long.select(F.col("a").alias("b"), F.col("k").alias("k_b")), "b", "left")
    more = F.least(F.coalesce("k_a", F.lit(0)), F.coalesce("k_b", F.lit(0)))
    for s in "ab":
        short = coinciding(short, s, f"d_{s}")
    short = scratch.put(short.filter(possible(F.col("shared") + more)).drop("k_a", "k_b", "d_a", "d_b"), "short")

    def links(pairs: DataFrame) -> DataFrame:
        """Of pairs with names those that are similar enough; only their sets are read."""
        numbers = pairs.select("a").union(pairs.select("b")).toDF("w").distinct()
        reps = scratch.put(numbers.join(classes, F.col("w") == F.col("cid")).select("rep_id"), "wanted")
        return scratch.put(similar(pairs, whole_sets(reps, docs)), "links")

    linked = components(links(short.filter("core")), scratch)
    if not lists.isEmpty():
        # what a class may share beside its long lists and the pairs decided so far
        beside = short.filter("not core").select("a", "b", "shared")
        beside = beside.select("a", "shared").union(beside.select("b", "shared")).groupBy("a").agg(F.max("shared").alias("s"))
        sized = lists.join(lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")), "list")
        first = F.slice(F.sort_array(F.collect_list(F.struct("size", "list", "core")), asc=False), 1, TOPS)
        tops = sized.groupBy("a").agg(first.alias("t")).select("a", F.col("t.list").alias("tops"), F.col("t.core").alias("core_tops"))
        about = coinciding(in_long.join(beside, "a", "left").join(tops, "a").fillna(0, ["s"]), "a", "d")
        in_lists = scratch.put(sized.join(about, "a"), "members")

        def mixed(linked: DataFrame) -> DataFrame:
            """The long lists with classes of more than one component c."""
            by = in_lists.join(linked, F.col("a") == F.col("node"), "left").withColumn("c", F.coalesce("component", "a")).drop("node", "component")
            several = by.groupBy("list").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("list")
            return scratch.put(by.join(several, "list", "left_semi"), "mixed")

        def joined(linked: DataFrame, pairs: DataFrame) -> DataFrame:
            for s in "ab":
                pairs = pairs.join(ids.select(F.col("cid").alias(s), F.col("m1").alias(f"{s}1"), F.col("m2").alias(f"{s}2")), s)
            return components(links(scratch.put(pairs, "pairs")).union(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)

        left = mixed(linked)
        if not left.isEmpty():
            # pairs of a few classes that a hash puts side by side join most components
            place = F.pmod(F.xxhash64("a", "list", "turn"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            cells = left.filter(F.array_contains("tops", F.col("list"))).withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS)))).withColumn("cell", F.floor(place * F.ceil(F.col("size") / CELL)))
            other = cells.select("list", "turn", "cell", F.col("a").alias("b"), F.col("n_a").alias("n_b"), F.col("c").alias("c_b"), F.col("k").alias("k_b"), F.col("s").alias("s_b"), F.col("d").alias("d_b"))
            near = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
            near &= F.col("core") & (100 * F.col("n_a") >= PERCENT * F.col("n_b")) & (F.col("c") != F.col("c_b"))
            some = cells.withColumnRenamed("d", "d_a").join(other, ["list", "turn", "cell"]).filter(near & possible(F.least("k", "k_b") + F.least("s", "s_b")))
            linked = joined(linked, some.select("a", "b", "n_a", "n_b").distinct())
            linked = joined(linked, meetings(mixed(linked)))
    named = classes.join(linked, F.col("cid") == F.col("node"), "left").select("n", "m1", "m2", "rep_id", "copies", F.coalesce("component", "cid").alias("c"))
    smallest = named.groupBy("c").agg(F.min("rep_id").alias("component_id"))
    name = F.struct("n", "m1", "m2").alias("name")
    named = scratch.put(named.join(smallest, "c").select(name, "copies", "component_id"), "named")
    out = left_join(rows.filter("n > 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), name), named, "name", "copies", n_texts).select("doc_id", "mark", "n_shingles", "component_id")
    out = stash(out.unionByName(rows.filter("n = 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "components")
    scratch.drop()
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: of each component those of its smallest doc_id.

    All rows with a null doc_id stay, as no identifier tells them apart. Of a repeated doc_id
    those rows go whose own text is in a component with a smaller one.
    """
    gone, (id_, mark) = members(docs).filter("component_id < doc_id"), map(free, ("id", "mark"))
    gone = stash(gone.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).distinct(), "gone")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(gone, (F.col("doc_id") == F.col(id_)) & (F.xxhash64(text) == F.col(mark)), "left_anti")
