"""An open-addressed table of n-grams in numpy.

The words of many texts are brought side by side into one buffer, a space between them, so
that every n-gram is a span of it. Spans are hashed by xxhash64 eight bytes at a time, all at
once; a span whose key is taken compares its bytes with the owner's and goes on to the next
slot where they differ.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
PIECE = 1 << 20  # bytes of text at a time
BLOCK = 1 << 17  # words whose n-grams are in one table
# The five primes that define xxhash64: fixed values.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


LONG = 64  # bytes from which spans are hashed one by one


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte, and each of the four pairs of bytes of a 64-bit word, adds to a CRC-32."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = (byte >> 1) ^ np.where(byte & 1, np.uint32(0xEDB88320), np.uint32(0))
    ahead = [byte]
    for _ in range(7):
        ahead.append((ahead[-1] >> 8) ^ byte[ahead[-1] & 255])
    pair = np.arange(1 << 16)
    return byte, np.stack([ahead[7 - 2 * k][pair & 255] ^ ahead[6 - 2 * k][pair >> 8] for k in range(4)])


_BYTE, _PAIRS = _crc_tables()


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


class Spans:
    """A buffer with eight bytes of room behind it, which can be read as 64-bit words from any byte on."""

    def __init__(self, data: np.ndarray) -> None:
        self.size = len(data)
        self.data = np.zeros(self.size + 8, np.uint8)
        self.data[: self.size] = data
        self.lanes = np.ndarray((self.size + 1,), "<u8", self.data, 0, (1,))

    def lane(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Eight bytes from `at` on, those beyond `length` as zero."""
        return self.lanes[at] & (~U(0) >> (U(8) * (U(8) - np.minimum(length, 8).astype(U))))

    def keys(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """xxhash64 (seed 0) of each span; spans are never empty."""
        h = P5 + length.astype(U)
        short = np.flatnonzero(length < 32)
        at, left, now = start[short], length[short], h[short]
        for _ in range(3):
            go = np.flatnonzero(left >= 8)
            if not len(go):
                break
            k = _rotate(self.lanes[at[go]] * P2, 31) * P1
            now[go] = _rotate(now[go] ^ k, 27) * P1 + P4
            at[go] += 8
            left[go] -= 8
        go = np.flatnonzero(left >= 4)
        now[go] = _rotate(now[go] ^ ((self.lanes[at[go]] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[go] += 4
        left[go] -= 4
        for _ in range(3):
            go = np.flatnonzero(left > 0)
            now[go] = _rotate(now[go] ^ (self.data[at[go]].astype(U) * P5), 11) * P1
            at[go] += 1
            left[go] -= 1
        now = (now ^ (now >> U(33))) * P2
        now = (now ^ (now >> U(29))) * P3
        h[short] = now ^ (now >> U(32))
        view = memoryview(self.data)
        for i in np.flatnonzero(length >= 32).tolist():
            a = int(start[i])
            h[i] = xxhash.xxh64_intdigest(view[a : a + int(length[i])])
        return h

    def _step(self, lane: np.ndarray) -> np.ndarray:
        low = U(0xFFFF)
        return _PAIRS[0][lane & low] ^ _PAIRS[1][(lane >> U(16)) & low] ^ _PAIRS[2][(lane >> U(32)) & low] ^ _PAIRS[3][lane >> U(48)]

    def crc32(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The unsigned CRC-32 of each span.

        A span is read in 64-bit words that end where it ends; zeros before it add nothing,
        once the register's first value is taken into the span's first four bytes.
        """
        out = np.empty(len(start), np.uint32)
        few = np.flatnonzero(length < 4)
        at, left, crc = start[few], length[few], np.full(len(few), 0xFFFFFFFF, np.uint32)
        for k in range(3):
            go = np.flatnonzero(left > k)
            crc[go] = _BYTE[(crc[go] ^ self.data[at[go] + k]) & 255] ^ (crc[go] >> 8)
        out[few] = ~crc
        some = np.flatnonzero((length >= 4) & (length < LONG))
        some = some[np.argsort(-length[some], kind="stable")]  # longest first, so those that go on are a prefix
        pad = (-length[some]) & 7
        by, ones = (pad * 8).astype(U), U(0xFFFFFFFF)
        crc = self._step((self.lanes[start[some]] ^ ones) << by)
        carry = np.where(pad > 4, ones >> (U(64) - np.maximum(by, U(1))), U(0))
        at, words = start[some] + 8 - pad, (length[some] + pad) // 8
        for k in range(1, LONG // 8):
            m = int(np.searchsorted(-words, -k, "left"))
            if not m:
                break
            lane = self.lanes[at[:m] + 8 * (k - 1)] ^ crc[:m]
            crc[:m] = self._step(lane ^ carry[:m] if k == 1 else lane)
        out[some] = ~crc
        view = memoryview(self.data)
        for i in np.flatnonzero(length >= LONG).tolist():
            out[i] = zlib.crc32(view[int(start[i]) : int(start[i] + length[i])])
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether spans of one length hold the same bytes."""
        out = np.ones(len(a), bool)
        go, done = np.arange(len(a)), 0
        while len(go):
            left = length[go] - done
            out[go] = self.lane(a[go] + done, left) == self.lane(b[go] + done, left)
            go, done = go[out[go] & (left > 8)], done + 8
        return out


class Table:
    """The distinct ones among spans: each occurrence's slot, and for each slot the owner's span and how often it occurs."""

    def __init__(self, spans: Spans, start: np.ndarray, length: np.ndarray, buckets: int, keys: np.ndarray | None = None) -> None:
        size = 1 << max(4, int(2 * len(start) - 1).bit_length())
        keys = spans.keys(start, length) if keys is None else keys
        owner = np.full(size, -1, np.int64)
        place = (keys & U(size - 1)).astype(np.int64)
        self.slot = np.empty(len(start), np.int64)
        rest = np.arange(len(start))
        while len(rest):
            s = place[rest]
            free = owner[s] < 0
            owner[s[free]] = rest[free]  # of several the last one owns the slot
            o = owner[s]
            same = (keys[o] == keys[rest]) & (length[o] == length[rest])
            check = np.flatnonzero(same & (o != rest))
            same[check] = spans.equal(start[o[check]], start[rest[check]], length[rest[check]])
            self.slot[rest[same]] = s[same]
            rest = rest[~same]
            place[rest] = (place[rest] + 1) & (size - 1)
        self.used = np.flatnonzero(owner >= 0)
        owns = owner[self.used]
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[self.used] = spans.crc32(start[owns], length[owns]) % np.uint32(buckets)


def pieces(raw: np.ndarray, cuts: np.ndarray, again: int, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Texts `first` to `last` (without it), their bytes, where they begin and end, and how many words the piece repeats.

    A text longer than `most` bytes comes in pieces of its own, cut between words; each but
    the first begins with the last `again` words of the one before.
    """
    first = 0
    while first < len(cuts) - 1:
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + most, "right")) - 1)
        a, end = int(cuts[first]), int(cuts[last])
        if end - a <= most:
            yield first, last, raw[a:end], cuts[first : last + 1] - a, 0
        else:
            skip, reach = 0, most
            while True:
                b = min(a + reach, end)
                while b < end and _WORD[raw[b - 1]] and _WORD[raw[b]]:  # within a word: on to where it ends
                    gap = np.flatnonzero(~_WORD[raw[b : min(b + most, end)]])
                    b = b + int(gap[0]) if len(gap) else min(b + most, end)
                yield first, last, raw[a:b], np.array([0, b - a]), skip
                if b == end:
                    break
                word = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[raw[a:b]])).astype(np.int8)) == 1)
                skip = min(again, len(word))
                a = a + int(word[len(word) - skip]) if skip else b
                reach = max(most, 2 * (b - a))  # the next piece has to go beyond what it repeats
        first = last


def words_of(raw: np.ndarray, cuts: np.ndarray) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """The words, lowered, with one space behind each: the buffer, where words begin and end in it, and the number of words before each cut."""
    n = len(raw)
    word = _WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:] = after[:-1] = word
    start, end = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    length = end - start
    to = np.cumsum(length + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    solid = np.ones(len(out), bool)
    solid[to - 1] = False
    out[solid] = _LOWER[raw[word]]
    return Spans(out), to - 1 - length, to - 1, np.searchsorted(start, cuts)


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text begins and the last one ends."""
    if not len(text):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, places, data = text.buffers()
    at = np.frombuffer(places, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def tables(text: pa.Array, order: int, buckets: int) -> Iterator[tuple[int, int, Table, np.ndarray, np.ndarray]]:
    """The n-grams of up to `order` words of all texts, in tables: first and last text, table, each occurrence's text from `first` on, and the words that each of these texts has in it."""
    raw, cuts = buffer_of(text)
    for first, last, own, own_cuts, skip in pieces(raw, cuts, order - 1):
        spans, start, end, upto = words_of(own, own_cuts)
        text_of = np.repeat(np.arange(last - first), np.diff(upto))
        for a in range(0, len(start), BLOCK):
            i = np.arange(a, min(a + BLOCK, len(start)))
            begins, lengths, texts = [], [], []
            for n in range(1, order + 1):
                j = i[i + n - 1 < len(start)]
                j = j[(text_of[j] == text_of[j + n - 1]) & (j + n - 1 >= skip)]
                begins.append(start[j])
                lengths.append(end[j + n - 1] - start[j])
                texts.append(text_of[j])
            n_words = np.bincount(texts[0], minlength=last - first)
            if sum(map(len, begins)):
                yield first, last, Table(spans, np.concatenate(begins), np.concatenate(lengths), buckets), np.concatenate(texts), n_words
