"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from millrace.llm import fingerprints, importance_sampling, jaccard_join, language_id, mixing_model, oracles, quality_rules, sentencepiece_codec, source_mixing, suffix_dedup, url_filter
from millrace.llm.common import crc_fold, documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = crc_fold("doc_id", 4) == 2
    model = language_id.fit(docs, ~held)
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_model.score(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(documents(spark, sf_dir))


def op5_quality_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    return importance_sampling.sample(documents(spark, sf_dir), good)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.apply_policy(quality_rules.measure(documents(spark, sf_dir)), "v1")
    failed = F.col("mask").bitwiseAND(F.lit(quality_rules.bits(quality_rules.POLICIES["base"]))) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "mask")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_lm_scoring, op3_suffix_dedup, op4_sentencepiece_codec, op5_quality_sampling, op6_source_mixing, op7_url_filter, op8_jaccard_join, op9_fingerprints, op10_quality_rules)}

ORACLE_SQL: dict[str, str] = {"op6_source_mixing": oracles.SOURCE_MIXING, "op8_jaccard_join": oracles.JACCARD_JOIN, "op10_quality_rules": oracles.QUALITY_RULES}
