"""A corpus pipeline from the training-data operators.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and works on all
rows that the stage before it kept. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuskit.llm import bpe, langid, linededup, mixing, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told (null text or no letter)."""
    return langid.keep_identified(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that many sources share from every document with words of its own."""
    return linededup.remove_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates; one without an id if none has one."""
    return simhash.keep_one(docs, null_ids=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes nearest to its target, shuffled in shards."""
    return mixing.mix(docs, whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the decoded bytes."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("simhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: BPE, language profiles and fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
