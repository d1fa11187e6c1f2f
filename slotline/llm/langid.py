"""Language identification by Bayesian evidence fusion.

Four pieces of evidence on a row's language are multiplied:

- the text: byte 1- to 3-gram likelihoods of each language, learned from labelled texts;
  overlapping grams aren't independent, so their sum is damped (DAMP) and bounded (MOST);
- the language that the markup declares and the suffix of the address: P(value | language);
- the host: P(language | host), smoothed towards its site, the site towards all rows.

The tables of the last three are grouped aggregations of the text's own posteriors over
all rows; what a row itself gave to them is taken out when it is judged, so that no text
counts twice. `und` stands for none of the languages: it has the likelihood of a text whose
grams are MARGIN nats worse each than those of the LOW-quantile of the texts learned from
with SURE grams or more (of all of them, if none is as long), or that has no letters. A row
is rejected if `und` is likeliest.

Declared languages are of two or three letters and suffixes of two, so that their tables
have a few thousand rows at most and are broadcast. Hosts are joined; those that hold a
thousandth of all rows or more, which are a thousand at most, are broadcast.

Bounds of the training sample (the only sample here): about TRAIN_DOCS labelled texts, a
share of all by hashed id and text, of at most TRAIN_BYTES bytes, and no more than twice
TRAIN_DOCS. Everything else covers all rows.

Defined cases. A null or empty text has no letters and is `und`. Null or unreadable declared
languages, suffixes and hosts are no evidence; a site counts by its hosts, so that a row
without a host has none. Null ids stay null; repeated rows are judged each for itself. Of
languages that are equally likely the first by name is given. Without any labelled text
every row is `und`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import free, hashed_share, left_join, small_batches, stash, tidy

TRAIN_DOCS, TRAIN_BYTES = 2000, 30_000
GRAMS = 1 << 15
DAMP, MOST, MARGIN = 0.3, 200.0, 2.0
LOW, SURE = 0.01, 400
PRIOR_ROWS = 5.0
UND = "und"
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_BLANK = np.array([b in b" \t\n\x0b\x0c\r.,;:!?" for b in range(256)])  # ends a word
_WORD = _LETTER | (np.arange(256) == 32)


def gram_ids(raw: bytes) -> np.ndarray:
    """A hashed id of each 1-, 2- and 3-gram of a text's bytes; ASCII capitals as small letters.

    Numbers, signs and what touches them belong to no language: a gram is of letters, and of
    spaces where words begin or end.
    """
    b = np.frombuffer(b" " + raw.lower() + b" ", np.uint8)
    b = np.where(_BLANK[b], np.uint32(32), b)
    fits, letter = _WORD[b], _LETTER[b]
    two = b[:-1] * 257 + b[1:] + 1000
    three = two[:-1] * 263 + b[2:] * 31 + 77
    pair = fits[:-1] & fits[1:] & (letter[:-1] | letter[1:])
    return np.concatenate([b[letter], two[pair] * 2654435761 >> 17, three[pair[:-1] & fits[2:]] * 2654435761 >> 17]) % GRAMS


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # grams x languages, log likelihoods
    floor: float  # mean log likelihood a gram below which a text is of no language

    def evidence(self, raw: bytes) -> list[float]:
        """Damped log likelihoods of each language and of `und`, the best at 0."""
        if not self.languages or not _LETTER[np.frombuffer(raw, np.uint8)].any():
            return [-MOST] * len(self.languages) + [0.0]
        ids = gram_ids(raw)
        got = np.zeros(len(self.languages))
        for k in range(0, len(ids), 1 << 20):
            got += self.table[ids[k : k + (1 << 20)]].sum(axis=0, dtype=np.float64)
        out = np.append(got, len(ids) * self.floor) * DAMP
        return np.maximum(out - out.max(), -MOST).tolist()


def train(texts: list[bytes], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    counts = np.zeros((GRAMS, len(languages)))
    found = [gram_ids(t) for t in texts]
    for ids, lang in zip(found, labels, strict=True):
        counts[:, languages.index(lang)] += np.bincount(ids, minlength=GRAMS)
    table = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * GRAMS)).astype(np.float32)
    own = np.array([table[ids].mean(axis=0).max() for ids in found])
    sure = np.array([len(ids) >= SURE for ids in found], bool)
    return Model(languages, table, float(np.quantile(own[sure] if sure.any() else own, LOW)) - MARGIN if len(own) else 0.0)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """A model from a bounded sample of the rows of `docs` (doc_id, text, lang) that name a language."""
    lang = F.lower(F.trim(F.col("lang").cast("string")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    rows = hashed_share(rows.filter((F.length("lang") > 0) & (F.col("lang") != UND)), train_docs, "doc_id", "text")
    rows = rows.filter(F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= train_bytes))
    got = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(2 * train_docs).toPandas()
    return train([t.encode() for t in got["text"]], got["lang"].tolist())


def text_evidence(rows: DataFrame, model: Model, *more: str) -> DataFrame:
    """id, declared, suffix, site, host, `more` (long columns) and `seen`, the text's log likelihoods, for `rows` with a text."""
    saved = pickle.dumps(model)
    kept = ["id", "declared", "suffix", "site", "host", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(saved)
        for b in batches:
            seen = pa.array([model.evidence(t.encode()) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), seen], [*kept, "seen"])

    return rows.select(*kept, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), "id long, declared string, suffix string, site string, host string, " + "".join(f"{c} long, " for c in more) + "seen array<double>")


def _softmax(logs: Column) -> Column:
    most = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - most))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda s, y: s + y))


def fuse(rows: DataFrame, model: Model, *more: str) -> DataFrame:
    """id, lang, confidence, rejected and `more`, long columns of the rows.

    `rows`: id, text, declared, suffix, site, host; any of them may be null.
    """
    small_batches(rows.sparkSession)
    names = [*model.languages, UND]
    n = len(names)
    vocabulary = lambda c, letters: F.when(F.col(c).rlike(f"^[a-z]{letters}$"), F.col(c)).alias(c)
    rows = rows.select("id", "text", vocabulary("declared", "{2,3}"), vocabulary("suffix", "{2}"), "site", "host", *more)
    seen = stash(text_evidence(rows, model, *more).withColumn("post", _softmax(F.col("seen"))), "langid")
    sums = F.array(*[F.coalesce(F.sum(F.col("post")[k]), F.lit(0.0)) for k in range(n)])
    total, all_rows = seen.agg(sums, F.count(F.lit(1))).first()

    def given(key: str) -> DataFrame:
        """The posteriors' sums for each value of a small vocabulary."""
        return F.broadcast(seen.filter(F.col(key).isNotNull()).groupBy(key).agg(sums.alias(f"{key}_sums")))

    hosts = seen.filter(F.col("host").isNotNull()).groupBy("host").agg(F.min("site").alias("site"), sums.alias("host_sums"), F.count(F.lit(1)).alias("host_rows"))
    hosts = stash(hosts, "hosts")
    sites = hosts.filter(F.col("site").isNotNull()).groupBy("site").agg(F.array(*[F.sum(F.col("host_sums")[k]) for k in range(n)]).alias("site_sums"), F.sum("host_rows").alias("site_rows"), F.count(F.lit(1)).alias("site_hosts"))
    hosts = left_join(hosts, sites, "site", "site_hosts", hosts.count()).drop("site", "site_hosts")
    out = left_join(seen.drop("site"), hosts, "host", "host_rows", all_rows)
    out = out.join(given("declared"), "declared", "left").join(given("suffix"), "suffix", "left")

    def others(of: Column, k: int) -> Column:
        """The sum less what the row itself gave."""
        return F.greatest(F.lit(0.0), of - F.col("post")[k])

    logs = []
    for k in range(n):
        prior = (others(F.lit(total[k]), k) + 1.0) / (all_rows - 1.0 + n)
        for level in ("site", "host"):
            own = (others(F.col(f"{level}_sums")[k], k) + PRIOR_ROWS * prior) / (F.col(f"{level}_rows") - 1 + PRIOR_ROWS)
            prior = F.coalesce(own, prior)
        told = [F.coalesce(F.log((others(F.col(f"{key}_sums")[k], k) + 0.5) / (others(F.lit(total[k]), k) + 50.0)), F.lit(0.0)) for key in ("declared", "suffix")]
        logs.append(F.col("seen")[k] + F.log(prior) + told[0] + told[1])
    out = out.withColumn("fused", _softmax(F.array(*logs))).withColumn("best", F.array_max("fused"))
    lang = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("fused", F.col("best")).cast("int"))
    return out.select("id", lang.alias("lang"), F.round("best", 6).alias("confidence"), (lang == UND).alias("rejected"), *more)


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows for `fuse`: the source is the host, nothing is declared."""
    null = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"), null.alias("declared"), null.alias("suffix"), null.alias("site"), F.col("source").cast("string").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows for `fuse`: tags are taken off the text, the rest is read from markup and address."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    blank = lambda x: F.when(F.length(x) > 0, x)
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"&#?\w+;", " ")
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    site = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    country = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    folder = F.lower(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1))
    return pages.select(F.col("page_id").cast("bigint").alias("id"), text.alias("text"), blank(declared).alias("declared"), F.coalesce(blank(country), blank(folder)).alias("suffix"), blank(site).alias("site"), blank(host).alias("host"))


def identify(docs: DataFrame) -> DataFrame:
    """The query's form for documents: doc_id, lang, confidence, rejected."""
    return fuse(document_rows(docs), fit(docs)).withColumnRenamed("id", "doc_id")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't rejected, with all their columns.

    Rows of one doc_id, or without any, go each by its own text; rows repeated in both that
    differ in their source stay or go together, and go if one of them is rejected.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = document_rows(docs.select("doc_id", "text", "source")).withColumn("mark", mark)
    id_, mark_ = map(free, ("id", "mark"))
    bad = fuse(rows, fit(docs), "mark").filter("rejected").select(F.col("id").alias(id_), F.col("mark").alias(mark_)).distinct()
    bad = stash(bad, "rejected")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (mark == F.col(mark_)), "left_anti")
