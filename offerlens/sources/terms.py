"""Search terms of crawls: seeds to term lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..dims import SEARCH_TERMS
from ..functions.numeric import strip


def default_terms(spark: SparkSession) -> DataFrame:
    """(shop, seed, terms): the short built-in lists; longer ones come as a table of the user."""
    rows = [(shop, seed, terms) for (shop, seed), terms in SEARCH_TERMS.items()]
    return spark.createDataFrame(rows, "shop string, seed string, terms array<string>")


def shops_without_terms(seeds: DataFrame, terms: DataFrame) -> list[str]:
    """Shops of the seeds that have no list at all."""
    missing = seeds.select("shop").distinct().join(terms, "shop", "left_anti")
    return sorted(str(r[0]) for r in missing.collect())  # shops


def expand_terms(seeds: DataFrame, terms: DataFrame, fallback_seed: str | None = None, every_shop: bool = False) -> DataFrame:
    """Seeds (shop, seed) to (shop, seed, term).

    A seed is looked up trimmed and lower-cased; an unknown one stands for
    itself. With ``fallback_seed`` blanks count as '_' and unknown seeds take
    the list of that seed, the way accessory crawls do. With ``every_shop`` a shop without any list is an error.
    """
    if every_shop and (missing := shops_without_terms(seeds, terms)):
        raise ValueError(f"no search terms for {', '.join(missing)}")
    key = F.lower(strip(F.col("seed")))
    asked = seeds.withColumn("_key", F.replace(key, F.lit(" "), F.lit("_")) if fallback_seed else key)
    known = terms.select("shop", F.col("seed").alias("_key"), "terms")
    found = asked.join(known, ["shop", "_key"], "left")
    if fallback_seed:
        other = terms.where(F.col("seed") == fallback_seed).select("shop", F.col("terms").alias("_other"))
        found = found.join(other, "shop", "left").withColumn("terms", F.coalesce("terms", "_other"))
    return found.select("shop", "seed", F.explode(F.coalesce("terms", F.array("seed"))).alias("term"))
