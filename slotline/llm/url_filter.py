"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And mask, a bit for each pattern
position. The automaton reads the canonical URL (lower-cased host, then path, as UTF-8)
one byte at a time and moves every pattern of every URL of a batch at once: the state is
an array of URLs x 64-bit words.

Glob language: `*` any run of bytes but `/`, `**` any run, `?` one byte but `/`, all else
itself. A pattern has to cover the whole canonical URL. Of the patterns that match, a
stated rule goes before the method's own, then the longest wins, then the first.

Defined cases. A null URL or one without `://` has an empty host and path, which no rule
of this module matches, and is allowed. URLs of any length are read whole. Repeated rows
are judged each for itself. Of other columns nothing is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


STATE = 1 << 21  # words of 64 bits that a group of URLs has for its state


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    globs: tuple[str, ...]
    stated: bool = False


def site_rule(verdict: str, site: str) -> Rule:
    """A host with all its subdomains, and the start of a path: `example.net/en/`."""
    return Rule(verdict, site, (f"{site}**", f"*.{site}**"), True)


#: The four stated rules, then the method's own: hosts with a label of a junk network.
RULES = (
    site_rule("block", "net/"),
    site_rule("allow", "example.net/en/"),
    site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
    *(Rule("block", x, (f"{x}.*", f"{x}.*/**", f"*.{x}.*", f"*.{x}.*/**")) for x in ("spam-*", "cheap-*", "casino-*", "adult-*", "ads-*", "free-bets")),
)


def rules_of(rows: DataFrame, most: int = 10_000) -> tuple[Rule, ...]:
    """Rules from a table (verdict, name, globs, stated), in order of name; more than `most` are refused, as every task holds all masks.

    Null or empty globs make no rule; a null verdict blocks, a null `stated` is false.
    """
    kept = rows.select(F.coalesce("verdict", F.lit("block")).alias("verdict"), "name", F.filter("globs", lambda g: g.isNotNull()).alias("globs"), F.coalesce("stated", F.lit(False)).alias("stated"))
    got = kept.filter("size(globs) > 0 and name is not null").orderBy("name", "verdict", "globs", "stated").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rules")
    return tuple(Rule(r.verdict, r.name, tuple(r.globs), r.stated) for r in got)


class Automaton:
    """Masks of all globs of all rules."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        steps: list[tuple[str, int, int]] = []  # literal byte or wildcard at each position, by pattern
        start, loop_any, loop_seg, accept = [], [], [], []
        for k, rule in enumerate(rules):
            for glob in rule.globs:
                first, raw, i = len(steps), glob.encode(), 0
                steps.append(("start", 0, k))
                start.append(first)
                while i < len(raw):
                    if raw[i : i + 2] == b"**":
                        loop_any.append(len(steps) - 1)
                        i += 2
                    elif raw[i : i + 1] == b"*":
                        loop_seg.append(len(steps) - 1)
                        i += 1
                    else:
                        steps.append(("any" if raw[i] == ord("?") else "byte", raw[i], k))
                        i += 1
                accept.append((len(steps) - 1, k))
        self.words = (len(steps) + 63) // 64
        self.start, self.any, self.seg = self._mask(start), self._mask(loop_any), self._mask(loop_seg)
        self.next = np.stack([self._mask([i for i, (kind, b, _) in enumerate(steps) if kind == "byte" and b == c or kind == "any" and c != ord("/")]) for c in range(256)])
        self.order = np.array(sorted(range(len(rules)), key=lambda k: (not rules[k].stated, -len(rules[k].name))), np.int32)
        rank = {int(k): place for place, k in enumerate(self.order)}
        self.accept = [(i // 64, i % 64, rank[k]) for i, k in accept]  # word and bit of each pattern's end, and its rule's rank

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def run(self, urls: list[bytes]) -> np.ndarray:
        """The index of the winning rule of each URL, or -1; URLs go in groups whose state holds STATE words at most (or one URL)."""
        size = max(1, STATE // max(1, self.words))
        parts = [self._run(urls[k : k + size]) for k in range(0, len(urls), size)]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def _run(self, urls: list[bytes]) -> np.ndarray:
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        size = np.array([len(urls[i]) for i in order], np.int64)
        ends = np.cumsum(size)
        flat, begin = np.frombuffer(b"".join(urls[i] for i in order), np.uint8), ends - size
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        active = len(urls)
        for t in range(int(size[0]) if len(urls) else 0):
            active = int(np.searchsorted(-size[:active], -t, "left"))  # longest first, so those still reading are a prefix
            now, c = state[:active], flat[begin[:active] + t]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.next[c]
            moved |= now & self.any
            moved |= np.where((c != ord("/"))[:, None], now & self.seg, np.uint64(0))
            state[:active] = moved
        best = np.full(len(urls), len(self.order), np.int32)
        for word, bit, rank in self.accept:
            hit = (state[:, word] >> np.uint64(bit)) & one != 0
            best[hit] = np.minimum(best[hit], rank)
        out = np.empty(len(urls), np.int32)
        out[order] = np.append(self.order, np.int32(-1))[best]
        return out


def canonical(url: str = "url") -> tuple:
    """Columns for host and path of a URL."""
    rest = F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return lower, path


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule (the stated rule that won, else null), verdict, glob_rule (the method's own, else null)."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            got = automaton.run([(h + p).encode() for h, p in zip(hosts, paths, strict=True)])
            hit = [rules[k] if k >= 0 else None for k in got.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in ("page_id", "host", "path")),
                    pa.array([r.name if r and r.stated else None for r in hit], pa.string()),
                    pa.array([r.verdict if r else "allow" for r in hit], pa.string()),
                    pa.array([r.name if r and not r.stated else None for r in hit], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict", "glob_rule"],
            )

    host, path = canonical()
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(match, "page_id long, host string, path string, rule string, verdict string, glob_rule string")
