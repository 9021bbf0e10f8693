"""The registered queries of this subpackage, and SQL counterparts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, decontamination, embedding_dedup, fill_in_middle, language_id, license_scan, minhash_dedup, one_bit_search,
    quality, secret_scan, sql, suffix_dedup, target_resampling, toxicity,
)
from .common import fold, stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language_id.train(docs.where(fold(3) != 1))
    return language_id.identify(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, folder, "documents"), size=2)


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = secret_scan.find_secrets(docs, secret_scan.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_table(spark, folder, "documents")).drop("spans")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    network = toxicity.train(docs, labels.where(fold(5) != 0))
    found = toxicity.score_documents(docs, network)
    more = [c for c in found.columns if c not in ("doc_id", "score", "predicted")]
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted", *more)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.score_documents(docs, quality.train(docs))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"))


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op11_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return target_resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_one_bit_search(spark: SparkSession, folder: str) -> DataFrame:
    return one_bit_search.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.transform(stored(fill_in_middle.frames(_table(spark, folder, "documents"))))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_embedding_dedup, op3_suffix_dedup, op4_language_id, op5_decontamination, op6_license_scan, op7_secret_scan, op8_byte_bpe, op9_quality, op10_minhash_dedup,
    op11_target_resampling, op12_one_bit_search, op13_fill_in_middle)}
SQL: dict[str, str] = {
    "op2_embedding_dedup": sql.EMBEDDING_DEDUP, "op3_suffix_dedup": sql.SUFFIX_DEDUP, "op10_minhash_dedup": sql.MINHASH_DEDUP,
    "op11_target_resampling": sql.TARGET_RESAMPLING, "op12_one_bit_search": sql.EXACT_SEARCH, "op13_fill_in_middle": sql.FILL_IN_MIDDLE}
