"""Corpus preparation in five stages over ``documents``.

Language identification drops what it rejects, one document of each group of near copies stays, secrets
are replaced by marks, sources are mixed to their target weights, and the result is packed into windows.
Each stage reads what the one before it wrote, and first releases what that one stored on the way; all but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliotab.llm import language, mixing, near_dup, packing, secrets
from foliotab.llm.shared import release, stored

#: SQL has no language models, tokenizers or secret marks: tests compare with a brute-force version.
ORACLE_SQL = None


def accept_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return language.accepted_rows(docs, language.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return near_dup.representatives(docs)


def mark_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return secrets.redacted(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", accept_languages),
    ("near_copies", drop_near_copies),
    ("secrets", mark_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
