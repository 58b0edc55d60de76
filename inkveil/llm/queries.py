"""The named queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import (
    chat,
    decontamination,
    language,
    language_model,
    line_dedup,
    near_dedup,
    packing,
    personal_data,
    prefix_trie,
    quality,
    secrets,
    substring_dedup,
    whitening,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), TOKENIZER)


def op3_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data.span_report(table(spark, sf, "documents"))


def op4_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(table(spark, sf, "documents")).drop("masked")


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document and benchmark item that stands in it."""
    return decontamination.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("_key")


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.without_repeats(table(spark, sf, "documents")))


def op8_chat_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return chat.render(table(spark, sf, "conversations"))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = line_dedup.deduplicated(table(spark, sf, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op11_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.score_held_out(table(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_personal_data": op3_personal_data,
    "op4_near_dedup": op4_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_chat_collapse": op8_chat_collapse,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_language_model": op11_language_model,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}
