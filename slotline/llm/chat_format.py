r"""Chat formatting with a grammar round trip.

A conversation is the concatenation of its turns, and every turn is one sentence of a
deterministic grammar:

    user       [INST] text [/INST]
    system     <<SYS>>\n text \n<</SYS>>\n\n
    assistant  (space) text </s>
    any other  <|role|> role <|text|> text <|end|>

`render` writes a turn plainly, parses it again and compares; as long as the turn read back
differs from the source it escapes more: at level 1 the content begins with `<|esc|>` and
its `\`, `<` and `[` are written `\\`, `\l` and `\i`, after which no control string can
occur in it. A turn that parses back alone does so in any conversation, because its closing
string is the first one found in it. Only assistant texts bear loss.

Turns are sorted within partitions that hold whole conversations and are streamed, so a
conversation of any length needs the memory of one turn. One conversation is the work of one
task, as places in its text and the digests of its turns follow from all turns before.

Defined cases. A null text or role is empty; an empty role is of the last kind. Turns go by
(turn, role, text), null turns first; repeated rows are turns of their own. Rows with a null
conv_id form one conversation. Of other columns nothing is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPED = "<|esc|>"
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "assistant": (" ", "</s>")}
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: What an escaped character is written as.
CODES = {"\\": "\\\\", "<": "\\l", "[": "\\i"}
PLAIN = {code[1]: char for char, code in CODES.items()}

FORMATTED = "conv_id long, position long, role string, text string, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return ESCAPED + text.translate(str.maketrans(CODES))


def unescape(content: str) -> str:
    if not content.startswith(ESCAPED):
        return content
    out, escaped = [], False
    for c in content[len(ESCAPED) :]:
        if escaped:
            out.append(PLAIN.get(c, c))  # a plain text may begin like an escaped one; `render` then finds it changed
        elif c != "\\":
            out.append(c)
        escaped = c == "\\" and not escaped
    return "".join(out)


def parse(text: str) -> tuple[str, str, int, int, int] | None:
    """role, text, start and end of the content, and end of the first turn; None if it has no end."""
    frame = next(((role, *f) for role, f in FRAMES.items() if text.startswith(f[0])), None)
    if frame is None:
        if not text.startswith(ROLE) or (cut := text.find(TEXT)) < 0:
            return None
        frame = (unescape(text[len(ROLE) : cut]), text[: cut + len(TEXT)], END)
    role, opening, closing = frame
    at = len(opening)
    end = text.find(closing, at)
    if end < 0:
        return None
    return role, unescape(text[at:end]), at, end, end + len(closing)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its content, escaped until it reads back identical."""
    for level in (str, escape):
        content = level(text)
        opening, closing = FRAMES.get(role) or (ROLE + level(role) + TEXT, END)
        out = opening + content + closing
        if (got := parse(out)) and got[:2] == (role, text) and got[4] == len(out):
            return out, len(opening), len(opening) + len(content)
    raise ValueError(f"a turn doesn't read back: {role!r} {text[:80]!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """A row per turn, each conversation whole and in order within its partition.

    The conversation's text is its `formatted` strings, one after the other; loss_start and
    loss_end are places in that text, null where a turn bears no loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, position = (), 0, 0
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b, out = whole.slice(k, 1000), []
                for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if last != (conv,):
                        last, place, position = (conv,), 0, 0
                    formatted, start, end = render(role, text)
                    bears = role == "assistant"
                    out.append((position, formatted, place + start if bears else None, place + end if bears else None))
                    place, position = place + len(formatted), position + 1
                pos, formatted, start, end = zip(*out, strict=True)
                columns = [b.column("conv_id"), pa.array(pos, pa.int64()), b.column("role"), b.column("text"), pa.array(formatted, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FORMATTED.split(", ")])

    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


class Reader:
    """Reads one conversation's formatted text back, piece by piece."""

    def __init__(self) -> None:
        self.rest, self.turns, self.loss_chars, self.chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str) -> list[tuple[str, str]]:
        self.rest += formatted
        self.chars += len(formatted)
        got = []
        while self.rest and (turn := parse(self.rest)):
            role, text = turn[:2]
            self.rest = self.rest[turn[4] :]
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            got.append((role, text))
        return got

    def bear(self, content: str) -> str:
        """Count the content of a span under the loss mask, and return its text."""
        text = unescape(content)
        self.loss.update(text.encode())
        self.loss_chars += len(text)
        return text

    def row(self, conv: int | None) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv} ends within a turn")
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation of `format_turns`, from its formatted text; each turn must equal its source.

    Loss is read through the mask, the spans from loss_start to loss_end, which must hold each
    assistant's text and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        reader, last, out = Reader(), (), []
        for b in batches:
            for conv, role, text, formatted, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "formatted", "loss_start", "loss_end")), strict=True):
                if last != (conv,):
                    if last:
                        out.append(reader.row(*last))
                    reader, last = Reader(), (conv,)
                place = reader.chars
                if reader.feed(formatted) != [(role, text)]:
                    raise ValueError(f"conversation {conv} doesn't read back")
                if (start is None) != (role != "assistant") or start is not None and reader.bear(formatted[start - place : end - place]) != text:
                    raise ValueError(f"conversation {conv} has a wrong loss mask")
            if len(out) > 1000:
                yield batch(out)
                out = []
        if last:
            out.append(reader.row(*last))
        if out:
            yield batch(out)

    return formatted.select("conv_id", "role", "text", "formatted", "loss_start", "loss_end").mapInArrow(run, READ)
