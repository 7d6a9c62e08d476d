"""Upserts, price drops and price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import half_even


def upsert(base: DataFrame, batch: DataFrame, order: list[str], updated: list[str]) -> DataFrame:
    """Insert a batch; on a known link only the ``updated`` columns change.

    Attributes come from the first row of a link, updated columns from the
    last, base before batch, then by ``order``, then by all columns. Both are picked by one
    aggregate with map-side combine, whose two structs hold the row once each. A missing link never collides.
    """
    names = base.columns
    rest = [c for c in names if c not in order]

    def place(df: DataFrame, part: int) -> DataFrame:
        return df.select(F.col("link"), F.struct(F.lit(part).alias("_part"), *order, *[c for c in rest if c != "link"]).alias("_at"))

    both = place(base.select(*names), 0).unionByName(place(batch.select(*names), 1))
    merged = both.where(F.col("link").isNotNull()).groupBy("link").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    merged = merged.select(*["link" if c == "link" else F.col(f"{'_last' if c in updated else '_first'}.{c}").alias(c) for c in names])
    unlinked = both.where(F.col("link").isNull())
    return merged.unionByName(unlinked.select(*["link" if c == "link" else F.col(f"_at.{c}").alias(c) for c in names]))


def upsert_offers(base: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    return upsert(base, batch, order, ["price", "date_scraped"])


def upsert_accessories(base: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    return upsert(base, batch, order, ["price", "currency", "date_scraped"])


def is_drop(new: Column, old: Column) -> Column:
    return (new > 0) & (new < old)


def alert_columns(new: Column, old: Column) -> list[Column]:
    return [
        half_even(old, 2).alias("old_price"), half_even(new, 2).alias("new_price"),
        half_even(old - new, 2).alias("diff"), half_even((old - new) / old * 100, 1).alias("percentage"),
    ]


def price_drops(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts of incoming offers that are cheaper than the stored offer of their link.

    ``stored`` has one row per link. Hot links sit on the incoming side only,
    where adaptive execution splits them.
    """
    known = stored.select("link", F.col("price").alias("_old"))
    joined = incoming.join(known, "link").where(is_drop(F.col("price"), F.col("_old")))
    currency = F.coalesce("currency", F.lit("EUR")) if "currency" in incoming.columns else F.lit("EUR")
    return joined.select(
        "title", *alert_columns(F.col("price"), F.col("_old")), currency.alias("currency"), "link", "source"
    )


def previous_price(
    df: DataFrame, key: str = "link", at: str = "date_scraped", price: str = "price", tie: tuple[str, ...] = (),
    period: str = "day",
) -> DataFrame:
    """Add ``old_price``: the price observed before, per key in time order.

    A key is split into time slots, so that a hot key is sorted in many tasks;
    the last price of the slot before is carried over by an aggregate.
    """
    order = [at, *tie, price]
    data = df.withColumn("_slot", F.date_trunc(period, F.col(at)))
    last = data.groupBy(key, "_slot").agg(F.max_by(price, F.struct(*order)).alias("_last"))
    by_slot = Window.partitionBy(key).orderBy("_slot")
    carried = last.select(
        F.col(key), F.col("_slot"), F.lag("_last").over(by_slot).alias("_carried")
    )
    inside = Window.partitionBy(key, "_slot").orderBy(*order)
    data = data.withColumn("_prev", F.lag(price).over(inside)).withColumn("_n", F.row_number().over(inside))
    joined = data.join(carried, [key, "_slot"])
    old = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_prev"))
    return joined.withColumn("old_price", old).select(*df.columns, "old_price")


def drops_over_time(df: DataFrame, key: str, at: str, price: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Alerts of a whole price history."""
    seen = previous_price(df, key, at, price, tie).withColumnRenamed("old_price", "_old")
    found = seen.where(is_drop(F.col(price), F.col("_old")))
    return found.select(key, at, *tie, *alert_columns(F.col(price), F.col("_old")))


def product_history(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Products with their latest price, price range (zeros without prices) and platform."""
    seen = prices.groupBy("product_id").agg(
        F.max_by("price", F.struct("scraped_at", "price")).alias("latest_price"),
        F.min("price").alias("_min"), F.max("price").alias("_max"), F.avg("price").alias("_avg"),
    )
    zero = F.lit(0.0)
    return products.join(seen, "product_id", "left").select(
        "product_id", "title", "category", F.col("latest_price").cast("double").alias("latest_price"),
        F.when(F.col("latest_price").isNotNull(), F.col("platform")).alias("platforms"),
        F.coalesce(F.col("_min").cast("double"), zero).alias("min_price"),
        F.coalesce(F.col("_max").cast("double"), zero).alias("max_price"),
        F.coalesce(F.col("_avg").cast("double"), zero).alias("avg_price"),
    )


def search_prices(searches: DataFrame, prices: DataFrame, products: DataFrame) -> DataFrame:
    """Price records of searches with their product."""
    return (
        searches.select("search_id", "query").join(prices, "search_id")
        .join(products.select("product_id", "title", "platform"), "product_id")
        .select("search_id", "query", "product_id", "title", "platform", "price", "scraped_at")
    )


def searches_with_counts(searches: DataFrame, prices: DataFrame, analyses: DataFrame) -> DataFrame:
    """Searches with their number of price records and whether an analysis exists."""
    counts = prices.groupBy("search_id").agg(F.count(F.lit(1)).alias("_n"))
    done = analyses.select("search_id").distinct().withColumn("_done", F.lit(True))
    return (
        searches.join(counts, "search_id", "left").join(done, "search_id", "left")
        .select(*searches.columns, F.coalesce("_n", F.lit(0)).cast("bigint").alias("product_count"),
                F.col("_done").isNotNull().alias("has_analysis"))
    )
