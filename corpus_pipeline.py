"""Corpus pipeline: language ID, exact dedup, near-duplicate join, mixing to target weights, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerlens.llm import stages
from offerlens.llm.common import shared_folder, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact_dedup_stage),
    ("ngram_jaccard_join", stages.near_dedup_stage),
    ("mix_sources", stages.mix_stage),
    ("packing", stages.pack_stage),
]

#: Language models, MinHash and tokenisation have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
