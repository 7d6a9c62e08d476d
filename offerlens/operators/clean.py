"""Cleaning of raw offers and the laptop/accessory split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.types import NumericType, StringType

from ..dims import (
    ACCESSORY_BOUNDS, ACCESSORY_RATES, ACCESSORY_VIEW_BOUNDS, ACCESSORY_VIEW_RATES, LISTING_RULES, LOAD_BOUNDS,
    OTHER_ACCESSORY_BOUNDS, OTHER_PRODUCT_BOUNDS, PRODUCT_BOUNDS,
)
from ..functions.features import price_range, truth_text
from ..functions.numeric import finite
from ..functions.prices import accessory_rate, price_in_mad
from ..functions.titles import accessory_is_gaming, collapse_blanks, contains_any, is_laptop_title
from .dedup import dedup_links


def load_bounds(df: DataFrame, column: str = "price") -> DataFrame:
    """Number prices within the load bounds, taken before any currency conversion."""
    number = F.col(column).try_cast("double")
    return df.withColumn("price", number).where(F.col("price").between(*LOAD_BOUNDS))


def priced(df: DataFrame) -> DataFrame:
    """Offers with a positive price."""
    return df.where(F.col("price") > 0)


def within_bounds(df: DataFrame, product_type: str = "laptop") -> DataFrame:
    """Offers within the price bounds of the product type (both ends included)."""
    return df.where(F.col("price").between(*PRODUCT_BOUNDS.get(product_type, OTHER_PRODUCT_BOUNDS)))


def convert_prices(df: DataFrame, once: bool = False) -> DataFrame:
    """Replace ``price`` by its MAD value.

    With ``once`` the value passes through a generator of one row, so that a
    later filter reads it instead of computing it again per comparison.
    """
    numeric = isinstance(df.schema["price"].dataType, NumericType)
    currency = F.col("currency") if "currency" in df.columns else None
    price = price_in_mad(F.col("price"), currency, numeric)
    return df.withColumn("price", F.explode(F.array(price)) if once else price)


def tidy_columns(df: DataFrame) -> DataFrame:
    """Squeeze titles, coerce the gaming flag and the scrape time."""
    out = df.withColumn("title", collapse_blanks(F.coalesce("title", F.lit("None"))))
    if "is_gaming" in df.columns:
        flag = F.col("is_gaming")
        if isinstance(df.schema["is_gaming"].dataType, StringType):
            flag = truth_text(flag)
        out = out.withColumn("is_gaming", F.coalesce(flag.cast("boolean"), F.lit(False)))
    if "date_scraped" in df.columns and isinstance(df.schema["date_scraped"].dataType, StringType):
        out = out.withColumn("date_scraped", F.try_to_timestamp("date_scraped"))
    return out


def clean_offers(
    df: DataFrame, product_type: str = "laptop", counters: tuple[Observation, Observation] | None = None
) -> DataFrame:
    """Prices to MAD, price bounds, one offer per link, tidy columns.

    ``counters`` are filled with row counts before and after as the plan runs,
    without a job of their own.
    """
    if counters:
        df = df.observe(counters[0], F.count(F.lit(1)).alias("rows"))
    # the bounds are positive, so they also drop missing and zero prices, before any row is sorted or shuffled
    out = tidy_columns(dedup_links(within_bounds(convert_prices(df, once=True), product_type)))
    if counters:
        out = out.observe(counters[1], F.count(F.lit(1)).alias("rows"))
    return out


def split_laptops(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Laptops by title word, and the complement."""
    laptop = is_laptop_title(F.col("title"))
    return df.where(laptop), df.where(~laptop)


def global_cleaning(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a mixed offer table and clean both sides.

    Prices are in MAD afterwards and ``currency`` says so, so that a second
    cleaning does not convert them again.
    """
    laptops, accessories = split_laptops(df)
    mad = F.lit("MAD")
    return (
        clean_offers(laptops, "laptop").withColumn("currency", mad),
        clean_offers(accessories, "accessory").withColumn("currency", mad),
    )


def relevant_listings(df: DataFrame, family: str) -> DataFrame:
    """Crawled offers whose title fits the family and whose price is high enough.

    Titles are lower-cased and terms are not, so a term with a capital never
    matches. Laptop titles are padded with a blank at both ends.
    """
    wanted, unwanted, lowest = LISTING_RULES[family]
    text = F.lower("title")
    if family == "laptop":
        text = F.concat(F.lit(" "), text, F.lit(" "))
    return df.where(contains_any(text, wanted) & ~contains_any(text, unwanted) & (F.col("price") >= lowest))


def prepare_accessories(
    df: DataFrame,
    bounds: dict[str, tuple[float, float]] | None = None,
    aliases: dict[str, str] | None = None,
    request_form: bool = False,
) -> DataFrame:
    """Accessory prices to MAD, category bounds, price range and gaming flag.

    ``aliases`` maps category names of crawled data to the names in ``bounds``;
    without it such categories take the default bounds.
    """
    bounds = bounds or (ACCESSORY_VIEW_BOUNDS if request_form else ACCESSORY_BOUNDS)
    price = F.col("price").try_cast("double")
    if "currency" in df.columns:
        rates = ACCESSORY_VIEW_RATES if request_form else ACCESSORY_RATES
        price = price * accessory_rate(F.col("currency"), rates, trimmed=request_form)
    # through a generator of one row, as in ``convert_prices``
    out = df.withColumn("price", F.explode(F.array(finite(price)))).where(F.col("price") > 0)
    if "accessory_category" not in out.columns:
        if "category" in out.columns:
            out = out.withColumnRenamed("category", "accessory_category")
        else:
            out = out.withColumn("accessory_category", F.lit("divers"))
    name = F.lower("accessory_category")
    for crawled, known in (aliases or {}).items():
        name = F.when(F.lower("accessory_category") == crawled.lower(), F.lit(known)).otherwise(name)
    lowest, highest = (F.lit(x) for x in OTHER_ACCESSORY_BOUNDS)
    for category, (a, b) in bounds.items():
        lowest = F.when(name == category, F.lit(a)).otherwise(lowest)
        highest = F.when(name == category, F.lit(b)).otherwise(highest)
    out = out.where(F.col("accessory_category").isNotNull() & F.col("price").between(lowest, highest))
    out = out.withColumn("price_range", price_range(name, F.col("price")))
    if "is_gaming" not in out.columns:
        out = out.withColumn("is_gaming", accessory_is_gaming(F.col("title")))
    return out


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Ad-hoc CSV cleaning: full rows with a price of at least 1500, one per link."""
    full = df.na.drop("any").withColumn("price", F.col("price").try_cast("double"))
    return dedup_links(full.where(F.col("price") >= LOAD_BOUNDS[0]))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column and rows with price zero, in one pass."""
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    return df.agg(*nulls, F.count_if(F.col("price").try_cast("double") == 0).alias("zero_prices"))


def nulls_for_json(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become null."""
    return df.withColumns({
        f.name: finite(F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")
    })
