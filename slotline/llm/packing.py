"""Packing into fixed sequences by vector bin packing.

Every example is a vector of tokens, one segment and its loss-bearing tokens, and every
sequence has a limit on each. A task keeps a bounded window of examples and one open
sequence; the dot-product heuristic places the example of the window whose vector has
the largest dot product with what is left of the sequence. When no example fits whole,
one is cut so that the sequence closes full, and its rest goes back to the window. A sequence
that another limit closes, and what is left over at the end of a task, is cut into
sequences whose lengths are powers of two, which need no padding. Nothing is shuffled, and a task holds WINDOW examples at most.

`instructions` makes examples of conversations: what is said up to an assistant's text is a
prompt without loss, the text and its closing string bear loss, so that all three limits
of INSTRUCTIONS bind. `pack_documents` packs texts, all of whose tokens bear loss.

Defined cases. Turns after a conversation's last assistant's text are an example without
loss; a null conv_id is a conversation of its own. A null text is empty: its only token is the end id. A null doc_id stays
null. Repeated rows are packed once each. Texts are tokenised whole: white space never
lies inside a token of this vocabulary, so words are looked up one by one.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import small_batches, texts, tidy

END_ID = 2
WINDOW = 256
MEMO_WORDS = 500_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


#: For instruction data: at most three quarters of a sequence's tokens bear loss (78 % do in the given conversations).
INSTRUCTIONS = Limits(4096, 24, 3072)


class Words(dict):
    """Bytes of a word (no white space inside) to its ids as little-endian uint32 bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        one = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: "".join(p for p, _ in one.pre_tokenize_str(chr(c))) for c in range(33, 256)}
        self.merges = self.tokenizer.model.tokenize
        self.special = tuple({x.content for x in self.tokenizer.get_added_tokens_decoder().values()})

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        """Letters up to U+00FF go straight to the merges, a full stop or comma after them is a token of its own."""
        text = word.decode()
        end = text[-1] if text[-1] in ".," else ""
        base = text[: len(text) - len(end)]
        plain = base.isascii()
        if base.isalpha() and (plain or max(base) <= "\u00ff"):
            small = base.lower()
            if small != text:
                known = (key := small.encode()) in self
                ids = self[key] + (self[end.encode()] if end else b"")
                if not known:  # only a word that comes again is worth a place for this form of it
                    return ids
            else:
                ids = array("I", [x.id for x in self.merges(small if plain else small.translate(self.table))]).tobytes()
        else:
            ids = self.encode(text)
        if len(self) < MEMO_WORDS and len(word) < 100:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.encode().split()))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


class Packer:
    """Packs examples given one after the other; `out` gathers rows of PIECES."""

    def __init__(self, limits: Limits, base: int) -> None:
        self.limits, self.next, self.out = limits, base, []
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.need = np.zeros((WINDOW + 1, 3))
        self.items: list[tuple] = []  # id, ids, start, prompt tokens, whole length
        self.open: list[tuple] = []
        self.used = np.zeros(3)

    @staticmethod
    def loss(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def add(self, doc_id: int | tuple | None, ids: bytes, prompt: int = 0) -> None:
        total, start = len(ids) // 4, 0
        whole = min(self.limits.tokens, self.limits.loss)
        while total - start >= whole:
            n = self.fit(start, total - start, prompt, self.cap)
            self.split([(doc_id, ids[start * 4 : (start + n) * 4], start, prompt, total)], n)
            start += n
        if start < total:
            self.wait((doc_id, ids[start * 4 :], start, prompt, total))
        while len(self.items) >= WINDOW:
            self.place()

    def wait(self, item: tuple) -> None:
        n = len(item[1]) // 4
        self.need[len(self.items)] = (n, 1, self.loss(item[2], n, item[3]))
        self.items.append(item)

    def take(self, k: int) -> tuple:
        item, last = self.items[k], self.items.pop()
        if k < len(self.items):
            self.items[k] = last
            self.need[k] = self.need[len(self.items)]
        return item

    def fit(self, start: int, n: int, prompt: int, left: np.ndarray) -> int:
        """How many of an example's next n tokens fit into what is left."""
        n = min(n, int(left[0]))
        return min(n, max(0, prompt - start) + int(left[2]))

    def place(self) -> None:
        """Move one example of the window, whole or cut, to the open sequence."""
        left = self.cap - self.used
        need = self.need[: len(self.items)]
        fits = (need <= left).all(axis=1)
        if left[1] == 1:  # the last segment has to fill the sequence
            fits &= need[:, 0] == left[0]
        if fits.any():
            scores = np.where(fits, (need / self.cap) @ (left / self.cap), -1.0)
            k = int(scores.argmax())
            self.put(self.take(k), need=True)
        else:
            # the longest example that some of fits: without room for loss one whose prompt isn't placed yet
            some = np.minimum(np.minimum(need[:, 0], left[0]), need[:, 0] - need[:, 2] + left[2])
            k = int(np.where(some > 0, need[:, 0], -1.0).argmax()) if left[1] else 0
            item = self.take(k)
            total = len(item[1]) // 4
            n = self.fit(item[2], total, item[3], left)
            if n:
                self.put((item[0], item[1][: n * 4], item[2], item[3], item[4]), need=True)
            if n < total:
                self.wait((item[0], item[1][n * 4 :], item[2] + n, item[3], item[4]))
            if n == 0 or self.used[1] >= self.cap[1]:
                self.close()
        if self.open and self.used[0] >= self.cap[0]:
            self.close()

    def put(self, item: tuple, need: bool) -> None:
        n = len(item[1]) // 4
        self.open.append(item)
        self.used += (n, 1, self.loss(item[2], n, item[3]))

    def close(self) -> None:
        self.split(self.open, int(self.used[0]))
        self.open, self.used = [], np.zeros(3)

    def split(self, rest: list[tuple], left: int) -> None:
        """Emit these `left` tokens as one sequence if they fill it, else as sequences whose lengths are powers of two."""
        while left:
            size = self.limits.tokens if left == self.limits.tokens else 1 << (left.bit_length() - 1)
            left -= size
            part = []
            while size:
                doc_id, ids, start, prompt, total = rest.pop(0)
                n = min(size, len(ids) // 4)
                part.append((doc_id, ids[: n * 4], start, prompt, total))
                size -= n
                if n * 4 < len(ids):
                    rest.insert(0, (doc_id, ids[n * 4 :], start + n, prompt, total))
            self.emit(part)

    def emit(self, items: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, prompt, total in items:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, ids, total, self.loss(start, n, prompt), self.next, offset))
            offset += n
        self.next += 1

    def finish(self) -> None:
        while self.items:
            self.place()
        self.close()


def tokenising(tokenizer_path: str, end_id: int = END_ID) -> Callable:
    """For mapInArrow: doc_id, part = 0, ids (little-endian uint32 bytes, the end id last) and prompt = 0, of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = words(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                ids = [memo.of(t) + end for t in part.column("text").to_pylist()]
                none = pa.array([0] * len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), none, pa.array(ids, pa.binary()), none], ["doc_id", "part", "ids", "prompt"])
        memo.clear()  # the worker stays for other tasks

    return run


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """The examples that `pack` takes, of texts."""
    return texts(docs).mapInArrow(tidy(tokenising(tokenizer_path, end_id)), "doc_id long, part long, ids binary, prompt long")


def instructions(turns: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id (the conversation), part (the position of the example's last turn), ids and prompt, of turns as `chat_format.format_turns` gives them.

    Each turn is tokenised for itself, an assistant's opening with its prompt; its text ends with the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = words(tokenizer_path), np.array([end_id], "<u4").tobytes()
        conv, prompt, last, out = (), [], 0, []

        def rows() -> pa.RecordBatch:
            d, part, ids, n = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(part, pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "part", "ids", "prompt"])

        def open_end() -> None:
            if prompt:
                ids = b"".join(prompt)
                out.append((*conv, last, ids, len(ids) // 4))
                prompt.clear()

        for b in batches:
            for doc_id, position, formatted, text, start in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "formatted", "text", "loss_start")), strict=True):
                if conv != (doc_id,):
                    open_end()
                    conv = (doc_id,)
                last = position
                if start is None:
                    prompt.append(memo.of(formatted))
                else:
                    before = b"".join(prompt)
                    prompt.clear()
                    out.append((doc_id, position, before + memo.of(text) + end, len(before) // 4))
                if len(out) >= 500:
                    yield rows()
        open_end()
        if out:
            yield rows()
        memo.clear()  # the worker stays for other tasks

    return turns.select("conv_id", "position", "formatted", "text", "loss_start").mapInArrow(tidy(run), "doc_id long, part long, ids binary, prompt long")


PART = f"{PIECES}, part long"


def packer_of(limits: Limits) -> Callable:
    """For mapInArrow: rows of PART of doc_id, part, ids and prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
        packer = Packer(limits, TaskContext.get().partitionId() << 40)

        def rows() -> pa.RecordBatch:
            got, packer.out = packer.out, []
            key, *rest = zip(*got, strict=True)
            doc_id, part = zip(*key, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip((doc_id, *rest), kinds, strict=True)), pa.array(part, pa.int64())], [*names, "part"])

        for b in batches:
            for doc_id, part, ids, prompt in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "ids", "prompt")), strict=True):
                packer.add((doc_id, part), ids, prompt or 0)
                if len(packer.out) >= 1000:
                    yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return run


def pack(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row per piece of each example. `examples`: doc_id, part (where a doc_id has several, else 0), ids and prompt (leading tokens without loss)."""
    return examples.select("doc_id", "part", "ids", "prompt").mapInArrow(tidy(packer_of(limits)), PART)


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits()) -> DataFrame:
    """The query's form: pieces with the digest of their ids; a task's texts are tokenised and packed by one worker."""
    small_batches(docs.sparkSession)
    tokens, packed = tokenising(tokenizer_path), packer_of(limits)
    pieces = texts(docs).mapInArrow(tidy(lambda batches: packed(tokens(batches))), PART)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_instructions(turns: DataFrame, tokenizer_path: str, limits: Limits = INSTRUCTIONS) -> DataFrame:
    """The query's form for conversations: conv_id, position (of an example's last turn) and its pieces, with their loss-bearing tokens."""
    pieces = pack(instructions(turns, tokenizer_path), limits)
    return pieces.select(F.col("doc_id").alias("conv_id"), F.col("part").alias("position"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("doc_tokens").alias("example_tokens"), "loss_tokens", "sequence_id", "offset")
