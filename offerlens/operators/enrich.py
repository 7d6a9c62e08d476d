"""All derived columns of an offer in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import features, titles


def add_features(df: DataFrame, compat: bool = False, full: bool = True) -> DataFrame:
    """Brand, sizes, processor, flags, levels and price ratios.

    Missing sizes stay missing; models impute them. ``full=False`` leaves out
    the columns the list form of the feature step does not have.
    """
    title, price = F.col("title"), F.col("price")
    brand = F.col("brand") if "brand" in df.columns else None
    gaming = titles.is_gaming_title(title)
    if "is_gaming" in df.columns:
        gaming = F.coalesce(F.col("is_gaming"), F.lit(False)) | gaming
    out = df.withColumns({
        "brand_detected": titles.detect_brand(title, brand),
        "ram_gb": titles.extract_ram(title),
        "storage_gb": titles.extract_storage(title),
        "storage_type": titles.storage_type(title),
        "cpu_score": titles.cpu_score(title),
        "has_gpu": titles.has_gpu(title),
        "price_category": features.price_category(price),
        "is_gaming": gaming,
        "log_price": features.log_price(price),
    })
    if not full:
        return out
    return out.withColumns({
        "cpu_generation": titles.cpu_generation(title),
        "is_tactile": titles.is_tactile(title),
        "is_refurbished": titles.is_refurbished(title),
        "ram_category": features.ram_category(F.col("ram_gb"), compat),
        "price_per_gb_ram": features.price_per_gb(price, F.col("ram_gb")),
    })


def feature_coverage(df: DataFrame) -> DataFrame:
    """Rows with a known memory and storage size, and their share in percent."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.count("ram_gb").alias("ram_known"),
        F.rint(F.count("ram_gb") / rows * 100).alias("ram_pct"),
        F.count("storage_gb").alias("storage_known"),
        F.rint(F.count("storage_gb") / rows * 100).alias("storage_pct"),
    )
