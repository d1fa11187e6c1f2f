"""A pipeline of the training-data operators over the documents table.

Each stage gets the rows that the one before it kept, written as Parquet and read again.
All but the last return the columns of documents, others that the table may have included,
whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotline.llm import exact_dedup, langid, mixing, ngram_join, packing
from slotline.llm.common import stash, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of no known language go.

    Null, empty and letterless texts go; rows of a repeated or null doc_id go each by its own
    text. Without any row that names a language all go.
    """
    return langid.accepted(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays.

    Null texts are empty and equal; a null doc_id is larger than any other; of rows repeated
    in doc_id and text one stays.
    """
    return exact_dedup.deduplicate(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest doc_id stays.

    Rows with a null doc_id all stay, texts without words are near nothing, and of a repeated
    doc_id only the rows whose own text is near that of a smaller doc_id go.
    """
    return ngram_join.representatives(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the rates that bring the label domains to their target weights.

    Texts without words stay once; null labels don't count; repeated rows get one rate and
    stay as often as it says each; without labels all is one domain.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens: of every row all tokens, of an empty or null text the end id."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", dedup_exact),
    ("ngram_join", dedup_near),
    ("mixing", mix_domains),
    ("packing", pack),
]

#: Language models, component searches and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
