"""Stored results that are valid as long as the offer table keeps its row count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.clean import nulls_for_json
from .offers import path_exists

SCHEMA = "cache_key string, result string, products_count bigint, is_valid boolean, created_at timestamp"


def snapshot(key: str, results: DataFrame, products: DataFrame) -> DataFrame:
    """Result rows as JSON with the current number of products."""
    counts = products.agg(F.count(F.lit(1)))
    return nulls_for_json(results).select(
        F.lit(key).alias("cache_key"), F.to_json(F.struct("*")).alias("result"),
        counts.scalar().alias("products_count"), F.lit(True).alias("is_valid"),
        F.current_timestamp().alias("created_at"),
    )


def save_snapshot(key: str, results: DataFrame, products: DataFrame, folder: str) -> None:
    """Replace the stored rows of one key; other keys stay untouched."""
    rows = snapshot(key, results, products)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(folder)


def valid_rows(stored: DataFrame, products: DataFrame) -> DataFrame:
    """Rows whose recorded count still equals the number of products."""
    current = products.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stored.where(F.col("is_valid") & (F.col("products_count") == current) & F.col("result").isNotNull())


def load_snapshot(spark: SparkSession, key: str, products: DataFrame, folder: str) -> DataFrame:
    """Valid result rows of a key; none for a miss."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    stored = spark.read.schema(SCHEMA).parquet(folder).where(F.col("cache_key") == key)
    return valid_rows(stored, products)


def invalidate(stored: DataFrame, key: str | None = None) -> DataFrame:
    """Mark the rows of one key, or of all keys, as no longer valid."""
    hit = F.lit(True) if key is None else F.col("cache_key") == key
    return stored.withColumn("is_valid", F.col("is_valid") & ~hit)
