"""Registered queries of the training-data operators over the supplied tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dup, extraction, language, manifest, mixing, near_dup, packing, periodic, quality, secrets, sharding, toxicity,
               vector_dup)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _held_out() -> Column:
    """Rows that nothing may be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf, "labels")))


def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf, "documents"))


def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_shards(spark: SparkSession, sf: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    found = toxicity.score(docs, toxicity.train(docs, _table(spark, sf, "labels")))
    return found.select("doc_id", _held_out().alias("held_out"), "score",
                        (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"), "n_hits", "weight")


def op8_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(_table(spark, sf, "documents"))


def op9_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vector_dup.near_vectors(_table(spark, sf, "embeddings"))


def op10_html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract(_table(spark, sf, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.verified(manifest.manifest(manifest.document_leaves(_table(spark, sf, "documents"))))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    texts = docs.select("doc_id", periodic.repeating_tail(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.digests(periodic.find_runs(texts))


def op13_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dup.groups(_table(spark, sf, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mix_sources": op3_mix_sources,
    "op4_shards": op4_shards,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scans": op8_secret_scans,
    "op9_near_vectors": op9_near_vectors,
    "op10_html_main_text": op10_html_main_text,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_duplicates": op13_exact_duplicates,
}
ORACLES: dict[str, str] = {
    "op2_near_duplicates": near_dup.SQL,
    "op3_mix_sources": mixing.SQL,
    "op9_near_vectors": vector_dup.SQL,
    "op11_merkle_manifest": manifest.SQL,
    "op13_exact_duplicates": exact_dup.SQL,
}
