"""The operators of this package as registered queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cartlens.llm import substring, suffix
from cartlens.llm.ann import self_neighbours
from cartlens.llm.common import read
from cartlens.llm.langid import language_id
from cartlens.llm.licenses import license_labels
from cartlens.llm.merkle import verified_manifest
from cartlens.llm.mixing import mix
from cartlens.llm.packing import pack
from cartlens.llm.phrases import collocations
from cartlens.llm.quality import COUNTS, quality
from cartlens.llm.simhash import near_duplicates
from cartlens.llm.sql import OP1, OP11, OP12, OP13
from cartlens.llm.tokens import token_counts
from cartlens.llm.toxicity import toxicity

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.substring_dedup(read(spark, sf_dir, "documents")))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.suffix_dedup(read(spark, sf_dir, "documents")))


def op9_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_neighbours(read(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(read(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_language_id": op2_language_id,
    "op3_genetic_packing": op3_genetic_packing,
    "op4_toxicity": op4_toxicity,
    "op5_seed_extend_dedup": op5_seed_extend_dedup,
    "op6_robust_outliers": op6_robust_outliers,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_adaptive_scan": op9_adaptive_scan,
    "op10_token_counts": op10_token_counts,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_scan": op13_license_scan,
}

# DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op1_pareto_mix": OP1, "op11_phrase_collocations": OP11, "op12_merkle_manifest": OP12, "op13_license_scan": OP13,
}
