"""Queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import media

    docs = _table(spark, sf_dir, "documents")
    rows = media.media_columns(docs)
    return rows.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *rows.columns[1:])


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import lm

    return lm.score_table(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import substrings

    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import extraction

    return extraction.main_text(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import mixing

    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", *mixing.ADDED)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import common, counts

    counted = counts.token_counts(_table(spark, sf_dir, "documents"), TOKENIZER, common.scratch(spark, "token-counts"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import quality

    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import secrets

    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.llm import decontamination

    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_media_columns, op2_lm_scoring, op3_substring_dedup, op4_html_extraction, op5_source_mixing, op6_token_counts,
        op7_minhash_near_dedup, op8_quality_classifier, op9_secret_scans, op10_benchmark_decontamination,
    )}


def oracle_sql() -> dict[str, str]:
    """The others hold a tokenizer, a fit, an image or a parser, which SQL cannot express; tests hold them to brute force."""
    from scanloom.llm import oracles

    return {"op3_substring_dedup": oracles.SUBSTRINGS, "op7_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op10_benchmark_decontamination": oracles.CONTAMINATION}
