"""Stages of the corpus pipeline: each applies an operator to all rows it gets and returns the columns it got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .common import WORD


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; those that the operator rejects go. Models are trained on all of ``docs``.

    A document travels as one struct, so that its columns keep their values whatever their names are.
    """
    from .language import train_and_identify

    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang")
    return train_and_identify(rows).where("_accepted").select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id."""
    from .exact_dedup import exact_dedup

    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"))
    same = rows["_id"].eqNullSafe(kept["_id"]) & (rows["_sha"] == kept["_sha"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["_id", "_sha"]).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with the smallest doc_id (null is the smallest, equal ones by a hash of
    the text); rows without words all stay. Rows are told apart by doc_id and text, so shared and null ids do no harm."""
    from .jaccard import jaccard_join

    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    keyed = docs.select(F.col("doc_id").alias("_id"), key.alias("doc_id"), "text")
    named = jaccard_join(keyed.select("doc_id", "text")).where("n_grams > 0").select("doc_id", "class_id").distinct()
    ids = keyed.select("_id", "doc_id").distinct().join(named, "doc_id").select("class_id", F.struct("_id", F.col("doc_id").alias("_key")).alias("_row"))
    first = ids.groupBy("class_id").agg(F.min("_row").alias("_first"))
    gone = ids.join(first, "class_id").where("_row._key <> _first._key").select(F.col("_row._key").alias("_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("_key"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_words"))
    rows = rows.join(gone, "_key", "left_anti").withColumn("_own", F.when(F.col("_words"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return rows.dropDuplicates(["_key", "_own"]).select("row.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    from .mixing import mixed_documents

    return mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    from .packing import pack_documents

    return pack_documents(docs, tokenizer=catalog.tokenizer_path())
