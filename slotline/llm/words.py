"""Hashes of the words of many texts at once, in numpy.

A word is a run between ASCII white space with A-Z lowered. Its hash is a polynomial in an
odd number over random 64-bit values of its bytes, mixed. As prefix sums of the whole buffer
give every word's polynomial, no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 19  # bytes of text at a time, or one text's word if that is longer
_BASE = 0x9E3779B97F4A7C17
_values = np.random.default_rng(0x5EED).integers(0, 1 << 64, 256, dtype=U)
_values[65:91] = _values[97:123]
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, U)
    x[0] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = _powers(_BASE, SEGMENT + 1), _powers(pow(_BASE, -1, 1 << 64), SEGMENT + 1)


def mix(h: np.ndarray, by: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(by)
    return h ^ (h >> U(31))


def word_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of texts that lie side by side in `raw`, and how many words come before each cut.

    `cuts` says where each text begins, and where the last one ends.
    """
    n = len(raw)
    solid = _SOLID[raw]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:] = after[:-1] = solid
    start, end = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    out, k = np.empty(len(start), U), 0
    while k < len(start):
        a = start[k]
        m = max(k + 1, int(np.searchsorted(end, a + SEGMENT, "right")))
        size = int(end[m - 1] - a)
        up, down = (_UP, _DOWN) if size < len(_UP) else (_powers(_BASE, size + 1), _powers(pow(_BASE, -1, 1 << 64), size + 1))
        sums = np.zeros(size + 1, U)
        np.cumsum(_values[raw[a : a + size]] * up[:size], out=sums[1:])
        s, e = start[k:m] - a, end[k:m] - a
        out[k:m] = mix((sums[e] - sums[s]) * down[s])
        k = m
    return out, np.searchsorted(start, cuts)


def chunks(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts `first` to `last` (without it), their words' hashes, and where each text's words begin and the last ones end."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, places, data = text.buffers()
    at = np.frombuffer(places, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SEGMENT, "right")) - 1)
        yield first, last, *word_hashes(raw[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last
