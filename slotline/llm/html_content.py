"""Main text of web pages by a tree-structured graphical model.

A page is a tree of block elements and blocks of text (`html_tree`), and each node a binary
variable: main text or not. A node's potential depends on what it is called and on how much
text and how many links are below it (see COMMON); a potential between parent and child says
how likely main text begins or ends at a node of that kind. Sum-product messages pass upward from the
deepest nodes and downward again, level by level for all pages of a batch at once, which
gives each node's exact marginal. Weights are trained by the gradient of the likelihood of
labelled pages, which the same messages give. Blocks whose marginal is over a half are the
text.

Labelled pages carry `data-main` on elements; `page_layouts` composes them, `labelled_sample`
takes them from a table.

Defined cases. A null or empty page, or one without main text, has an empty text and no
characters. Pages of any length are read whole, repeated ones each for itself, and a page
that breaks off as far as it goes. Null ids and URLs stay. A line break within a block is
white space; cells of a table are blocks. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import hashed_share, tidy
from slotline.llm.html_tree import MARK, Tree, parse
from slotline.llm.page_layouts import labelled_pages

GROUP = 4 << 20  # characters of pages whose trees are worked on together
STEPS, RATE = 250, 0.15  # training: gradient steps and their size
DECAY, COMMON_DECAY = 3e-4, 3e-3  # weight decay of names, and of features that every node has
#: These features and tags say where main text begins or ends, but not that a node is main text: else
#: the many blocks of a long page would together outweigh what their container is called.
COMMON = ("block", "element", "ends a sentence", "<p>", "<li>", "<td>", "<tr>", "<div>", "<ul>", "<ol>")


def _log2(x: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)


class Forest:
    """The trees of several pages side by side: structure and, for each node, its features' names."""

    def __init__(self, trees: list[Tree]) -> None:
        sizes = [len(t.parent) for t in trees]
        first = np.cumsum([0, *sizes])
        self.first = first
        n = int(first[-1])
        self.parent = np.fromiter((p + a if p >= 0 else -1 for t, a in zip(trees, first, strict=False) for p in t.parent), np.int64, n)
        self.depth = np.fromiter((d for t in trees for d in t.depth), np.int64, n)
        self.text = [x for t in trees for x in t.text]
        self.leaf = np.fromiter((x is not None for x in self.text), bool, n)
        self.main = np.fromiter((m for t in trees for m in t.main), bool, n)
        self.chars = np.fromiter((len(x) if x is not None else 0 for x in self.text), np.int64, n)
        self.linked = np.fromiter((x for t in trees for x in t.linked), np.int64, n)
        order = np.argsort(self.depth, kind="stable")
        ends = np.searchsorted(self.depth[order], np.arange(int(self.depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.chars_below, self.linked_below = self._below(self.chars), self._below(self.linked)
        self.names = [x for t in trees for x in t.names]

    def _below(self, values: np.ndarray) -> np.ndarray:
        out = values.copy()
        for level in reversed(self.levels[1:]):
            np.add.at(out, self.parent[level], out[level])
        return out

    def features(self, index: dict[str, int], grow: bool) -> tuple[np.ndarray, np.ndarray]:
        """Node and feature of each feature that a node has; names that `index` lacks are added, or left out."""
        size, share = _log2(self.chars_below), (4 * self.linked_below) // np.maximum(self.chars_below, 1)
        nodes, ids = [], []
        for k, (text, names, s, l) in enumerate(zip(self.text, self.names, size.tolist(), share.tolist(), strict=True)):
            kind = "block" if text is not None else "element"
            mine = [kind, f"{kind} of 2^{min(s, 9)}", f"{kind} with {l}/4 in links", *names]
            if text is not None:
                mine += [name for name, has in (("ends a sentence", text[-1] in ".!?:;…\"”"), ("copyright", "©" in text)) if has]
            for f in mine:
                i = index.setdefault(f, len(index)) if grow else index.get(f)
                if i is not None:
                    nodes.append(k)
                    ids.append(i)
        return np.array(nodes, np.int64), np.array(ids, np.int64)


def _add_exp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


@dataclass
class Beliefs:
    """Log potentials and messages; `node` is n x 2, `edge` n x 2 x 2 by the parent's state and the node's own."""

    up: np.ndarray
    out: np.ndarray
    pair: np.ndarray
    log_z: float

    @property
    def marginal(self) -> np.ndarray:
        """The probability of main text of each node."""
        both = self.up + self.out
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def sum_product(forest: Forest, node: np.ndarray, edge: np.ndarray) -> Beliefs:
    """Messages from the leaves up and from the roots down; `pair` is the marginal of a node's parent's state and its own."""
    up, to_parent, out = node.copy(), np.zeros_like(node), np.zeros_like(node)
    for level in reversed(forest.levels[1:]):
        e = edge[level] + up[level][:, None, :]
        to_parent[level] = _add_exp(e[:, :, 0], e[:, :, 1])
        np.add.at(up, forest.parent[level], to_parent[level])
    pair = np.zeros((len(node), 2, 2))
    for level in forest.levels[1:]:
        p = forest.parent[level]
        rest = up[p] - to_parent[level] + out[p]
        e = edge[level] + rest[:, :, None]
        out[level] = _add_exp(e[:, 0, :], e[:, 1, :])
        e += up[level][:, None, :]
        e = np.exp(e - e.max(axis=(1, 2), keepdims=True))
        pair[level] = e / e.sum(axis=(1, 2), keepdims=True)
    roots = forest.levels[0]
    return Beliefs(up, out, pair, float(_add_exp(up[roots, 0], up[roots, 1]).sum()))


@dataclass
class Model:
    """Weights of features: for being main text, for main text that begins at a node, for main text that ends at it."""

    index: dict[str, int]
    weights: np.ndarray  # 3 x features

    def potentials(self, n: int, nodes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, edge = np.zeros((n, 2)), np.zeros((n, 2, 2))
        own, begin, end = (np.bincount(nodes, w[ids], n) for w in self.weights)
        node[:, 1], edge[:, 0, 1], edge[:, 1, 0] = own, begin, end
        return node, edge

    def beliefs(self, forest: Forest) -> Beliefs:
        return sum_product(forest, *self.potentials(len(forest.parent), *forest.features(self.index, False)))


def fit(pages: list[str]) -> Model:
    """Train on labelled pages: gradient steps, each divided by a running mean of its own size, on the likelihood of all labels."""
    forest, index = Forest([parse(p) for p in pages]), {}
    nodes, ids = forest.features(index, True)
    y, n = forest.main, len(forest.parent)
    of_parent = np.where(forest.parent >= 0, y[forest.parent], False)
    inner = forest.parent >= 0
    seen = np.stack([y, inner & ~of_parent & y, inner & of_parent & ~y]).astype(float)
    model = Model(index, np.zeros((3, len(index))))
    common = np.array([f.startswith(COMMON) for f in index], bool)
    decay = np.where(common, COMMON_DECAY, DECAY)
    free = np.stack([~common, *[np.ones(len(index), bool)] * 2])
    speed, size = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for step in range(1, STEPS + 1 if pages else 1):
        b = sum_product(forest, *model.potentials(n, nodes, ids))
        off = seen - np.stack([b.marginal, b.pair[:, 0, 1], b.pair[:, 1, 0]])
        gradient = np.stack([np.bincount(ids, o[nodes], len(index)) for o in off]) / len(pages) * free - decay * model.weights
        speed, size = 0.9 * speed + 0.1 * gradient, 0.99 * size + 0.01 * gradient**2
        model.weights = model.weights + RATE * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-6)
    return model


def labelled_sample(rows: DataFrame, most: int = 2000, chars: int = 100_000) -> list[str]:
    """At most about `most` labelled pages (html) of a table, by a hashed share of those with a mark and at most `chars` characters."""
    marked = rows.select(F.col("html").cast("string").alias("html")).filter(F.contains("html", F.lit(MARK)) & (F.length("html") <= chars))
    return sorted(r.html for r in hashed_share(marked, most, "html").limit(2 * most).collect())


@lru_cache(maxsize=1)
def layout_model() -> Model:
    """The model trained on the composed pages of `page_layouts`."""
    return fit(labelled_pages())


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The blocks of main text of each page, one a line."""
    forest = Forest([parse(p) for p in pages])
    keep = (model.beliefs(forest).marginal > 0.5) & forest.leaf
    return ["\n".join(forest.text[k] for k in (a + np.flatnonzero(keep[a:b])).tolist()) for a, b in zip(forest.first.tolist(), forest.first[1:].tolist(), strict=False)]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    model = model or layout_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pa.compute.utf8_length(whole.column("html")).to_numpy(zero_copy_only=False)
            upto, a = np.cumsum(size), 0
            while a < len(whole):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + GROUP, "right")))
                some = whole.slice(a, b - a)
                texts = main_texts(some.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                a = b

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
