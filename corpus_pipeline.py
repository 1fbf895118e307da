"""The corpus pipeline: filtered by language, deduplicated twice, mixed to weights, packed.

Each stage takes the documents that the one before kept and returns documents again, the last one
returns the places of their pieces in the packed sequences. Stages are joined by written tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartlens.llm.common import documents, read, stage
from cartlens.llm.langid import language_model, with_known_language
from cartlens.llm.mixing import mixed_documents
from cartlens.llm.packing import pack
from cartlens.llm.queries import BYTE_VOCABULARY
from cartlens.llm.simhash import one_of_each
from cartlens.llm.suffix import cut_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; those without a letter go (all others stay if none is labelled)."""
    return with_known_language(docs, language_model(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier in the corpus."""
    return cut_documents(docs)


def pareto_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def genetic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the packed sequences."""
    return pack(docs, BYTE_VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("pareto_mix", pareto_mix),
    ("genetic_packing", genetic_packing),
]

# Model-based and iterative stages have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = documents(read(spark, sf_dir, "documents"))
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
