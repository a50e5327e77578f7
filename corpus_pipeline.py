"""The training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the shared folder and rereads as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelweave.llm.bpe import bpe_round_trip
from panelweave.llm.exact_dedup import keep_first
from panelweave.llm.language_id import keep_identified
from panelweave.llm.mixing import mixed_documents
from panelweave.llm.scratch import Scratch
from panelweave.llm.simhash import keep_representatives

VOCABULARY = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null texts, those without a letter, and those that no language is likelier for than all others together.

    The model is learned from the labelled documents; where there is none, those
    with a letter stay. Repeated rows stay or go together; an empty table gives an empty table; further columns stay.
    """
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, that of the largest id; null counts as empty, a null id yields to any other.

    Of rows equal in id and text one stays; an empty table gives an empty table; further columns stay.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of texts that are similar by 0.8 or more over shingles of five words.

    Similarity is told by SimHash fingerprints of 256 bits. Null and wordless
    texts are one group; of repeated rows one stays; an empty table gives an empty table; further columns stay.
    """
    return keep_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights.

    Null is a source of its own; documents without words go; repeated rows count each; an empty table gives an empty table; further columns stay.
    """
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens of each document, and the hashes of its ids and of what they decode to; a row for each row, null as empty."""
    return bpe_round_trip(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mixing", mixing),
    ("bpe", encoding),
]

#: Hash-based fingerprints and the trained model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
