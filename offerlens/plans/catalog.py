"""Registered queries: each takes (spark, folder of the test tables) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import features, numeric, prices, sql, titles
from ..operators import (
    anomaly, clean, cluster_quality, dedup, distribution, enrich, history, iforest, lof, projection, rules, sampling, scaling, search,
    search_analysis, segments, stats,
)
from ..session import shared_folder
from ..sources import cards, keyed, market, offers, snapshots, terms
from ..streaming import offers as offer_streams, upkeep
from . import report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_tables: dict[tuple, DataFrame] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def register(name: str, fn: Query) -> None:
    QUERIES[name] = fn


def _stored(kind: str, spark: SparkSession, sf: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Cleaned rows stay persisted for the session, as stages that many results read."""
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _tables:
        _tables[key] = build().persist()
    return _tables[key]


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_offers(market.market_offers(spark, sf))


def laptops(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned laptop offers with features; the features are not persisted, so that a result computes those that it reads."""
    return enrich.add_features(_stored("laptops", spark, sf, lambda: cleaned(spark, sf)))


def laptops_once(spark: SparkSession, sf: str) -> DataFrame:
    """``laptops`` for results that read them once: they persist no cleaned rows, but read those that are persisted already."""
    return enrich.add_features(cleaned(spark, sf))


def featured(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Some columns of ``laptops``, persisted for results that read them in many jobs."""
    return _stored(",".join(columns), spark, sf, lambda: laptops_once(spark, sf).select(*columns))


VECTOR = ["log_price", "ram_gb", "storage_gb", "cpu_score"]


def vectored(spark: SparkSession, sf: str) -> DataFrame:
    """What anomaly detectors over feature vectors read of ``laptops``."""
    return featured(spark, sf, "id", "link", "price", *VECTOR)


def accessories(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared accessories; they come from one pass over the lines, so nothing is persisted."""
    return clean.prepare_accessories(market.market_accessories(spark, sf))


def banded(spark: SparkSession, sf: str) -> DataFrame:
    return segments.price_bands(laptops(spark, sf))


OFFER_ID = ["link", "title", "price", "source"]

# --- reading, cleaning, writing ---------------------------------------------
register("load_laptops", lambda s, d: clean.load_bounds(market.market_offers(s, d)))
register("clean_laptops", lambda s, d: clean.clean_offers(market.market_offers(s, d)))
register("global_cleaning_laptops", lambda s, d: clean.global_cleaning(market.market_offers(s, d))[0])
register("global_cleaning_accessories", lambda s, d: clean.global_cleaning(market.market_offers(s, d))[1])
register("prepare_accessories", lambda s, d: accessories(s, d))
register("prepare_accessories_request", lambda s, d: clean.prepare_accessories(
    market.market_accessories(s, d), request_form=True))
register("export_rows", lambda s, d: offers.export_rows(laptops(s, d)))
register("drop_incomplete", lambda s, d: clean.drop_incomplete(market.market_offers(s, d)))
register("missing_counts", lambda s, d: clean.missing_counts(market.market_offers(s, d)))


def raw_text(spark: SparkSession, sf: str) -> DataFrame:
    """Offers as the text columns of a CSV file."""
    df = market.market_offers(spark, sf)
    stamp = F.date_format("date_scraped", "yyyy-MM-dd HH:mm:ss")
    flag = F.when(F.col("is_gaming"), F.lit("True")).otherwise(F.lit("False"))
    return df.withColumns({"page": F.col("page").cast("string"), "is_gaming": flag, "date_scraped": stamp,
                           "image": F.lit("")})


register("import_laptops", lambda s, d: offers.import_laptops(raw_text(s, d)).drop("image"))
register("import_accessories", lambda s, d: offers.import_accessories(raw_text(s, d).withColumns({
    "category": F.lit(""), "old_price": F.lit(""), "in_stock": F.lit("true")})).drop("image", "old_price"))
register("refresh_offers", lambda s, d: offers.refresh_offers(raw_text(s, d)).drop("image"))


def damaged_csv(spark: SparkSession, sf: str) -> offers.CsvRead:
    """All offers as CSV text, some lines with a field too many, one too few or a quote that does not close, read back."""
    df = raw_text(spark, sf)
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in offers.LAPTOP_CSV.fieldNames()]
    i = F.col("id")
    line = F.concat_ws(",", *quoted)
    line = F.when(i % 97 == 0, F.concat(line, F.lit(","))).when(
        i % 101 == 0, F.concat(F.lit('"open,'), F.col("source"))).when(i % 89 == 0, F.concat_ws(",", *quoted[:-1])).otherwise(line)
    folder = shared_folder(spark, "offers-csv")
    df.select(line).write.text(folder)
    return offers.read_csv_lines(spark, folder, offers.LAPTOP_CSV, header=False)


register("csv_rows", lambda s, d: offers.import_laptops(damaged_csv(s, d).rows).drop("image"))
register("csv_rejects", lambda s, d: damaged_csv(s, d).rejected.groupBy("reason").agg(
    F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters")))


@query
def price_parsers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("price")
    return market.market_offers(spark, sf).select(
        "id", raw.alias("raw"), prices.parse_price(raw).alias("free"), prices.offer_insert_price(raw).alias("insert_price"),
        prices.accessory_insert_price(raw).alias("accessory_insert"), prices.refresh_price(raw).alias("refresh"),
        prices.digits_price(raw).alias("digits"), prices.marketplace_price(raw).alias("marketplace"),
        prices.card_accessory_price(raw).alias("card"), prices.detect_currency(raw).alias("currency"),
        prices.currency_rate(F.col("currency")).alias("rate"),
        prices.accessory_rate(F.col("currency")).alias("accessory_rate"),
    )


@query
def title_features(spark: SparkSession, sf: str) -> DataFrame:
    return laptops(spark, sf).select(
        "id", "title", "price", "brand_detected", "ram_gb", "storage_gb", "storage_type", "cpu_score", "cpu_generation",
        "has_gpu", "is_tactile", "is_refurbished", "price_category", "ram_category", "is_gaming",
    )


@query
def price_features(spark: SparkSession, sf: str) -> DataFrame:
    return laptops(spark, sf).select("id", "link", F.round("log_price", 9).alias("log_price"), "price_per_gb_ram",
                                     features.basket_price_category(F.col("price")).alias("basket_level"))


@query
def text_helpers(spark: SparkSession, sf: str) -> DataFrame:
    title = F.col("title")
    return market.market_offers(spark, sf).select(
        "id", titles.first_word(title).alias("brand_word"), titles.normalized_title(title).alias("norm_title"),
        features.link_id(F.col("link")).alias("link_id"), titles.collapse_blanks(title).alias("tidy"),
        titles.is_laptop_title(title).alias("is_laptop"), titles.accessory_is_gaming(title).alias("acc_gaming"),
        features.shorten(title, 40).alias("short"),
        features.absolute_url(F.concat(F.lit("/item/"), F.col("page").cast("string")), "https://shop.example").alias("url"),
    )


@query
def sql_title_features(spark: SparkSession, sf: str) -> DataFrame:
    """``title_features`` as a SQL user writes it, with the registered functions."""
    sql.register_functions(spark)
    clean.clean_offers(market.market_offers(spark, sf)).createOrReplaceTempView("cleaned_offers")
    return spark.sql("""
        SELECT id, title, price, title_brand(title, brand) AS brand_detected, title_ram(title) AS ram_gb,
          title_storage(title) AS storage_gb, title_storage_type(title) AS storage_type, title_cpu_score(title) AS cpu_score,
          title_cpu_generation(title) AS cpu_generation, title_has_gpu(title) AS has_gpu,
          title_is_tactile(title) AS is_tactile, title_is_refurbished(title) AS is_refurbished,
          price_level(price) AS price_category, ram_level(title_ram(title)) AS ram_category,
          is_gaming OR title_is_gaming(title) AS is_gaming
        FROM cleaned_offers""")


@query
def sql_price_parsers(spark: SparkSession, sf: str) -> DataFrame:
    """``price_parsers`` with the registered functions."""
    sql.register_functions(spark)
    market.market_offers(spark, sf).createOrReplaceTempView("raw_offers")
    return spark.sql("""
        SELECT id, price AS raw, price_free(price) AS free, price_offer_insert(price) AS insert_price,
          price_accessory_insert(price) AS accessory_insert, price_refresh(price) AS refresh, price_digits(price) AS digits,
          price_marketplace(price) AS marketplace, price_card_accessory(price) AS card, price_currency(price) AS currency,
          currency_rate(currency) AS rate, accessory_currency_rate(currency) AS accessory_rate
        FROM raw_offers""")


# --- search and filters --------------------------------------------------------
register("search_by_query", lambda s, d: search.search_by_query(laptops(s, d), "Laptop").select("id", "title", "price", "search_query"))
register("search_offers", lambda s, d: search.search_offers(laptops(s, d), "gaming", search.PRODUCT_COLUMNS).select("id", "title", "price"))
register("search_accessories", lambda s, d: search.search_offers(accessories(s, d).withColumn(
    "category", F.col("accessory_category")), "usb", search.ACCESSORY_COLUMNS).select("id", "title", "category", "price"))
register("page_of_offers", lambda s, d: search.page_of(laptops(s, d).select("id", "link", "title", "price"), 3, 20))
@query
def page_after_offer(spark: SparkSession, sf: str) -> DataFrame:
    """The page after the second one, from that one's last row."""
    df = laptops(spark, sf).select("id", "link", "title", "price")
    seen = search.page_of(df, 2, 20).collect()
    return search.page_after(df, seen[-1], 20)


register("page_counts", lambda s, d: search.page_counts(laptops(s, d), 20))
register("filter_products", lambda s, d: search.filter_products(
    market.market_products(s, d), market.market_prices(s, d), "ECONOMY", None, 100000.0, 2000.0))
register("latest_searches_per_user", lambda s, d: search.latest_per_user(market.market_searches(s, d), 5))
register("recent_searches", lambda s, d: search.recent_searches(
    market.market_searches(s, d), 7, F.to_timestamp_ntz(F.lit("1998-08-01 00:00:00")), 365, 10))
register("active_alerts", lambda s, d: search.active_alerts(market.market_alerts(s, d), 7))
for _family in ["laptop", "mouse", "bag", "stand", "usb", "cooling"]:
    register(f"relevant_listings_{_family}", lambda s, d, family=_family: clean.relevant_listings(
        market.market_offers(s, d).withColumn("price", prices.digits_price(F.col("price"))), family
    ).select("id", "title", "price"))
register("bag_listings", lambda s, d: clean.relevant_listings(
    market.bag_offers(s, d).withColumn("price", prices.digits_price(F.col("price"))), "bag").select("id", "title", "price"))
register("nulls_for_json", lambda s, d: clean.nulls_for_json(laptops(s, d).select(
    "id", (F.col("price") / F.nullif(F.col("cpu_score"), F.lit(0))).alias("ratio"))))
register("accessory_gaming", lambda s, d: clean.prepare_accessories(
    market.market_accessories(s, d).drop("is_gaming")).select("id", "title", "is_gaming"))

# --- deduplication -------------------------------------------------------------
register("dedup_links", lambda s, d: dedup.dedup_links(clean.convert_prices(market.market_offers(s, d))))
register("dedup_without_link", lambda s, d: dedup.dedup_links(
    clean.convert_prices(market.market_offers(s, d)).drop("link", "id")).select("title", "price", "source", "brand", "page"))
register("dedup_listing", lambda s, d: dedup.dedup_listing(
    clean.convert_prices(market.market_offers(s, d)).select("id", "title", "price", "source", "link"), ["id"]))
register("dedup_display", lambda s, d: dedup.dedup_display(laptops(s, d).select("id", "title", "price", "link"), ["id"]))
CRAWL_ORDER = ["id", "link", "title", "source", "price"]
register("crawl_dedup", lambda s, d: dedup.crawl_dedup(
    market.market_offers(s, d).select("id", "title", "link", "source", "price"), CRAWL_ORDER))
register("crawl_dedup_check", lambda s, d: dedup.crawl_dedup_check(
    market.market_offers(s, d).select("id", "title", "link", "source", "price", "search_query"), CRAWL_ORDER))
register("crawl_dedup_runs_check", lambda s, d: dedup.crawl_dedup_check(
    market.market_offers(s, d).select("id", "title", "link", "source", "price", "search_query"), CRAWL_ORDER,
    ("source", "search_query")))
register("product_key", lambda s, d: dedup.product_key(market.market_products(s, d)).drop("product_key"))

# --- upserts and history ---------------------------------------------------------


def _base_and_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Older and newer half of the offers by scrape date."""
    df = clean.convert_prices(market.market_offers(spark, sf)).withColumn("price", F.coalesce("price", F.lit(0.0)))
    late = F.col("date_scraped") >= F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    return df.where(~late), df.where(late)


ORDER = ["date_scraped", "id"]


@query
def upsert_offers(spark: SparkSession, sf: str) -> DataFrame:
    base, batch = _base_and_batch(spark, sf)
    return history.upsert_offers(base, batch, ORDER).select("link", "title", "price", "currency", "date_scraped")


@query
def upsert_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """``upsert_offers`` into a keyed table: the older half as one batch, the newer half as a stream."""
    folder = shared_folder(spark, "offer-table")
    base, _ = _base_and_batch(spark, sf)
    table = keyed.KeyedTable(spark, f"{folder}/table", ["link"])
    offer_streams.upsert_batch(table, base, ORDER, "base", ["price", "date_scraped"])
    late = market.offer_stream(spark, sf).where(F.col("date_scraped") >= F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))
    late = clean.convert_prices(late).withColumn("price", F.coalesce("price", F.lit(0.0)))
    offer_streams.upsert_stream(late, f"{folder}/table", f"{folder}/checkpoint", ORDER).awaitTermination()
    return table.read().select("link", "title", "price", "currency", "date_scraped")


@query
def stats_upkept(spark: SparkSession, sf: str) -> DataFrame:
    """Price statistics by shop after three batches of upserts, from value counts that each batch brought up to date."""
    folder = shared_folder(spark, "offer-counts")
    df = clean.convert_prices(market.market_offers(spark, sf)).withColumn("price", F.coalesce("price", F.lit(0.0)))
    table = keyed.KeyedTable(spark, f"{folder}/table", ["link"])
    counts = upkeep.StoredCounts(spark, f"{folder}/counts", ["source"])
    year = F.year("date_scraped")
    for name, part in {"early": year < 1994, "middle": (year >= 1994) & (year < 1997), "late": year >= 1997}.items():
        offer_streams.upsert_batch(table, df.where(part), ORDER, name, ["price", "date_scraped"], (counts,))
    return counts.statistics()


@query
def upsert_accessories(spark: SparkSession, sf: str) -> DataFrame:
    base, batch = _base_and_batch(spark, sf)
    return history.upsert_accessories(base, batch, ORDER).select("link", "title", "price", "currency", "date_scraped")


@query
def price_drops(spark: SparkSession, sf: str) -> DataFrame:
    base, batch = _base_and_batch(spark, sf)
    stored = history.upsert_offers(base, base.limit(0), ORDER)
    return history.price_drops(batch, stored)


register("drops_over_time", lambda s, d: history.drops_over_time(
    market.price_events(s, d), "user_id", "ts", "price", ("event_id",)))
@query
def price_drops_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """``drops_over_time`` by the stream, over all events that are there now."""
    folder = shared_folder(spark, "price-drops")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumnRenamed("value", "price")
    names = {"key": "user_id", "at": "ts", "price": "price", "tie": ("event_id",)}
    offer_streams.price_drop_stream(events, folder, f"{folder}/checkpoint", **names).awaitTermination()
    return offer_streams.finish_drops(spark, folder, **names)


register("previous_price", lambda s, d: history.previous_price(
    market.price_events(s, d), "user_id", "ts", "price", ("event_id",)))
register("product_history", lambda s, d: history.product_history(
    market.market_products(s, d), market.market_prices(s, d)).withColumn("avg_price", numeric.half_even(F.col("avg_price"), 2)))
register("search_prices", lambda s, d: history.search_prices(
    market.market_searches(s, d), market.market_prices(s, d), market.market_products(s, d)))
register("searches_with_counts", lambda s, d: history.searches_with_counts(
    market.market_searches(s, d), market.market_prices(s, d), market.market_searches(s, d).where("status = 'F'")))

# --- statistics --------------------------------------------------------------------
register("descriptive_stats", lambda s, d: stats.descriptive_stats(laptops(s, d)))
register("price_percentiles", lambda s, d: stats.price_percentiles(laptops(s, d)))
register("stats_by_brand", lambda s, d: stats.stats_by_brand(laptops_once(s, d)))
register("stats_by_category", lambda s, d: stats.stats_by_category(laptops(s, d)))
register("stats_by_source", lambda s, d: stats.stats_by_source(laptops(s, d)))
register("boxplot_by_source", lambda s, d: stats.boxplot_by_source(laptops(s, d), with_std=True))
register("brand_bar", lambda s, d: stats.brand_bar(laptops(s, d)))
register("brand_chart", lambda s, d: stats.brand_chart(laptops(s, d)))
register("price_histogram", lambda s, d: distribution.plain_histogram(laptops(s, d)))
register("price_distribution", lambda s, d: distribution.price_distribution(laptops(s, d)))
register("chart_distribution", lambda s, d: distribution.chart_distribution(laptops(s, d)))
register("gaming_groups", lambda s, d: stats.gaming_groups(laptops(s, d)))
register("rank_sums", lambda s, d: stats.rank_sums(laptops(s, d)))
register("mann_whitney", lambda s, d: stats.mann_whitney(laptops(s, d)))
register("correlation_matrix", lambda s, d: stats.correlation_matrix(laptops_once(s, d)))
register("accessory_stats", lambda s, d: stats.accessory_stats(accessories(s, d)))
register("search_stats", lambda s, d: stats.search_stats(market.market_prices(s, d)).withColumns(
    {c: numeric.half_even(F.col(c).cast("double"), 2) for c in
     ["min_price", "max_price", "mean_price", "median_price", "std_price", "q1", "q3"]}))
def judged_prices(spark: SparkSession, sf: str) -> DataFrame:
    return search_analysis.judged_prices(market.market_prices(spark, sf))


register("search_clusters", lambda s, d: search_analysis.search_clusters(judged_prices(s, d)))
register("search_flagged", lambda s, d: search_analysis.search_flagged(
    market.market_search_prices(s, d), judged_prices(s, d)).select("search_id", "product_id", "title", "platform", "price", "score"))
register("search_reports", lambda s, d: search_analysis.search_reports(judged_prices(s, d)).select(
    "search_id", "count", *[F.get("centers", F.lit(i)).alias(f"center_{i}") for i in range(3)],
    F.array_join("cluster_names", ", ").alias("cluster_names"), "anomaly_count"))
register("platform_distribution", lambda s, d: stats.platform_distribution(
    laptops(s, d).withColumn("platform", F.col("source"))).withColumn("mean", numeric.half_even(F.col("mean"), 2)))
register("run_summary", lambda s, d: stats.run_summary(market.market_offers(s, d), ["Jumia", "Amazon", "AliExpress"]))
register("feature_coverage", lambda s, d: enrich.feature_coverage(laptops(s, d)))
register("currency_audit", lambda s, d: stats.currency_audit(market.market_offers(s, d)))
register("category_counts", lambda s, d: stats.category_counts(laptops(s, d), "price_category"))
register("anomaly_bands", lambda s, d: stats.anomaly_bands(dedup.dedup_display(
    anomaly.detect_zscore(laptops(s, d)).where("anomaly_zscore").select("id", "title", "price", "link"), ["id"])))
register("anomaly_list", lambda s, d: anomaly.anomaly_list(
    anomaly.detect_zscore(laptops(s, d)).select("id", "title", "price", "link", "price_category", "anomaly_zscore"),
    "anomaly_zscore", ["id", "title", "price", "link"], "entrée_de_gamme", descending=True).drop("anomaly_zscore"))
register("dashboard", lambda s, d: stats.dashboard(anomaly.detect_zscore(featured(s, d, "price", "brand_detected")), "anomaly_zscore"))
register("radar", lambda s, d: stats.radar(segments.cluster_table(banded(s, d)), ["median", "count", "mean"]))
register("row_counts", lambda s, d: laptops(s, d).agg(F.count(F.lit(1)).alias("rows")))

# --- scaling, segments, anomalies -----------------------------------------------------
for _method in ["minmax", "standard", "robust"]:
    register(f"scaled_{_method}", lambda s, d, m=_method: scaling.scaled(
        laptops(s, d).select("id", "link", "price", "ram_gb"), ["price", "ram_gb"], m))
register("normalized_prices", lambda s, d: scaling.normalized_prices(laptops(s, d).select("id", "link", "price")))
register("price_bands", lambda s, d: banded(s, d).select("id", "link", "price", "cluster_id", "cluster"))
register("band_quality", lambda s, d: segments.band_quality(banded(s, d)))
register("band_summary", lambda s, d: segments.cluster_summary(banded(s, d)))
register("band_table", lambda s, d: segments.cluster_table(banded(s, d)))
register("kmeans_summary", lambda s, d: segments.cluster_summary(segments.kmeans_segments(laptops(s, d))))
register("k_scores", lambda s, d: segments.score_k(laptops(s, d)))
register("k_scores_features", lambda s, d: segments.score_k(featured(s, d, "log_price", "ram_gb", "cpu_score").withColumn(
    "price_step", F.round("log_price", 2)), features=["price_step", "ram_gb", "cpu_score"], restarts=3))


@query
def best_k(spark: SparkSession, sf: str) -> DataFrame:
    """The number of segments that the report takes."""
    chosen = segments.choose_k(segments.score_k(laptops(spark, sf)))
    return spark.range(1).select(F.lit(chosen).alias("best_k"), F.lit(max(chosen, 5)).alias("used_k"))


QUALITY = ["x0", "x1", "x2"]


@query
def band_vector_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of the price bands and of brand groups over price, memory and processor."""
    df = banded(spark, sf).withColumns({
        "price_step": F.round("log_price", 2), "gaming_id": F.col("is_gaming").cast("int"),
        "gpu_id": F.col("has_gpu").cast("int") * 2 + F.col("is_tactile").cast("int")})
    points = segments.kmeans_points(df, ["price_step", "ram_gb", "cpu_score"])
    return cluster_quality.vector_quality(points, QUALITY, ["cluster_id", "gaming_id", "gpu_id"])


register("cluster_names", lambda s, d: segments.name_clusters(laptops(s, d).select(
    "id", "link", "price", (F.col("id") % 7 - 1).cast("int").alias("cluster_id"))))
register("detect_iqr", lambda s, d: anomaly.detect_iqr(laptops(s, d), 0.7).select("id", "link", "price", "anomaly_iqr", "anomaly_iqr_type"))
register("detect_zscore", lambda s, d: anomaly.detect_zscore(laptops(s, d)).select(
    "id", "link", "price", "anomaly_zscore", "zscore_value", "anomaly_zscore_type"))
register("detect_contextual", lambda s, d: anomaly.detect_contextual(banded(s, d), 0.7).select("id", "link", "price", "cluster", "anomaly_contextual"))
register("anomaly_summary", lambda s, d: anomaly.anomaly_summary(
    anomaly.detect_contextual(anomaly.detect_zscore(anomaly.detect_iqr(banded(s, d), 0.7)), 0.7)))
register("anomalies_by_price", lambda s, d: anomaly.anomalies(anomaly.detect_zscore(laptops(s, d)), "zscore").select("id", "link", "price"))
register("chart_anomalies", lambda s, d: anomaly.chart_anomalies(anomaly.detect_zscore(laptops(s, d)), "zscore"))
register("explained_anomalies", lambda s, d: anomaly.explained_anomalies(anomaly.detect_zscore(banded(s, d)), "zscore"))
register("isolation_forest", lambda s, d: iforest.detect_isolation_forest(vectored(s, d)).select(
    "id", "link", "price", "anomaly_iforest", "anomaly_iforest_score"))
register("local_outlier_factor", lambda s, d: lof.detect_lof(vectored(s, d)).select(
    "id", "link", "price", "anomaly_lof", "anomaly_lof_score"))
register("local_outlier_factor_steps", lambda s, d: lof.detect_lof(
    vectored(s, d).withColumn("price_step", F.round("log_price", 2)), ["price_step", "ram_gb", "storage_gb", "cpu_score"]).select(
    "id", "link", "price", "anomaly_lof", "anomaly_lof_score"))
register("pca_scatter", lambda s, d: projection.pca_scatter(segments.price_bands(featured(s, d, "title", "price", "brand_detected", *VECTOR))))

# --- samples -----------------------------------------------------------------------------
register("scatter_sample", lambda s, d: segments.scatter_row(sampling.hash_sample(banded(s, d), 300, OFFER_ID)))
register("random_offers", lambda s, d: sampling.hash_sample(
    clean.priced(laptops(s, d)).select("id", "link", "title", "price", "source"), 20, OFFER_ID, seed=7))
register("first_rows", lambda s, d: banded(s, d).orderBy(F.desc("id"), F.desc("link")).limit(500).select(
    "title", "price", "cluster", "brand_detected", "is_gaming", "cluster_id"))
register("every_nth", lambda s, d: sampling.every_nth(laptops(s, d).select("id", "link", "price"), 500, ["id"]))

# --- association rules ----------------------------------------------------------------------


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return rules.frequent_itemsets(rules.baskets(banded(spark, sf), rules.LAPTOP_ITEMS), 0.08)


register("frequent_itemsets", lambda s, d: _items(s, d).select(
    F.array_join("items", ", ").alias("itemset"), numeric.half_even(F.col("support"), 6).alias("support")))
register("frequent_itemsets_of_four", lambda s, d: rules.frequent_itemsets(
    rules.baskets(banded(s, d), [*rules.LAPTOP_ITEMS, "storage_type", "source"]), 0.05, 4).select(
    F.array_join("items", ", ").alias("itemset"), numeric.half_even(F.col("support"), 6).alias("support")))
register("laptop_rules", lambda s, d: rules.laptop_rules(banded(s, d)))
register("accessory_rules", lambda s, d: rules.accessory_rules(accessories(s, d)))
register("cross_rules", lambda s, d: rules.cross_rules(laptops(s, d), accessories(s, d)))
register("rules_by_consequent", lambda s, d: search.rules_by_consequent(rules.laptop_rules(banded(s, d)), "GPU", 10))
register("best_rules", lambda s, d: search.best_rules(rules.laptop_rules(banded(s, d)), 20))
register("find_rules", lambda s, d: search.find_rules(rules.laptop_rules(banded(s, d)), "gaming=oui", "confidence"))
register("rule_labels", lambda s, d: rules.laptop_rules(banded(s, d)).select(
    features.rule_label(F.col("antecedent")).alias("a"), features.rule_label(F.col("consequent")).alias("c"), "lift"))

# --- pages, terms, snapshots -------------------------------------------------------------------


def listing_pages(spark: SparkSession, sf: str, shop: str, per_page: int = 20, offered=market.market_offers) -> DataFrame:
    """Result pages of a shop, built from all of its offers: cards of consecutive ids share a page."""
    df = offered(spark, sf).where(F.col("source") == shop)
    path = F.concat(F.lit("/item/"), F.substring_index("link", "/", -1))
    card = {
        "Jumia": F.concat(
            F.lit('<article class="prd _fb"><a class="core" href="'), path, F.lit('"><img data-src="i.jpg" src="x"><h3 class="name">'),
            F.col("title"), F.lit('</h3><div class="prc">'), F.col("price"), F.lit(" Dhs</div></a></article>")),
        "Amazon": F.concat(
            F.lit('<div data-component-type="s-search-result"><img class="s-image" src="i.jpg"><h2><a href="'), path,
            F.lit('"><span>'), F.col("title"), F.lit('</span></a></h2><span class="a-price"><span class="a-offscreen">'),
            F.col("price"), F.lit(" €</span></span></div>")),
        "AliExpress": F.concat(
            F.lit('<div class="search-card-item"><a href="//fr.example'), path, F.lit('"><img src="//i.jpg"><h3>'),
            F.col("title"), F.lit('</h3><div class="lw_el">MAD'), F.col("price"), F.lit("</div></a></div>")),
    }[shop]
    page = F.floor(F.col("id") / (per_page * 10))
    return df.select(page.alias("n"), F.col("id"), card.alias("card")).groupBy("n").agg(
        F.concat(F.lit("<html><body>"), F.array_join(F.array_sort(F.collect_list("card")), ""), F.lit("</body></html>")).alias("html")
    ).select(F.concat(F.lit("https://shop.example/?page="), F.col("n").cast("string")).alias("url"), "html")


register("jumia_cards", lambda s, d: cards.jumia_offers(listing_pages(s, d, "Jumia")).drop("place", "url"))
for _family in ["mouse", "stand", "usb", "cooling"]:
    register(f"jumia_{_family}_listing", lambda s, d, family=_family: clean.relevant_listings(
        cards.jumia_offers(listing_pages(s, d, "Jumia"), family), family).drop("place", "url"))
register("jumia_bag_listing", lambda s, d: clean.relevant_listings(
    cards.jumia_offers(listing_pages(s, d, "Jumia", offered=market.bag_offers), "bag"), "bag").drop("place", "url"))
register("jumia_crawl_check", lambda s, d: dedup.crawl_dedup_check(clean.relevant_listings(
    cards.jumia_offers(listing_pages(s, d, "Jumia"), "mouse"), "mouse"), ["url", "place"]))
register("amazon_cards", lambda s, d: cards.amazon_offers(listing_pages(s, d, "Amazon")).drop("place", "url"))
register("amazon_accessory_cards", lambda s, d: cards.amazon_offers(listing_pages(s, d, "Amazon"), "bag").drop("place", "url"))
register("aliexpress_cards", lambda s, d: cards.aliexpress_offers(listing_pages(s, d, "AliExpress")).drop("place", "url"))
register("crawled_pages", lambda s, d: cards.aliexpress_offers(s.read.parquet(f"{d}/pages.parquet")))
register("expand_terms", lambda s, d: terms.expand_terms(
    market.market_offers(s, d).select(F.col("source").alias("shop"), F.col("search_query").alias("seed")).distinct(),
    terms.default_terms(s)))
register("snapshot_rows", lambda s, d: snapshots.valid_rows(
    snapshots.snapshot("by_source", stats.category_counts(laptops(s, d), "source"), laptops(s, d)), laptops(s, d)
).select("cache_key", "result", "products_count", "is_valid"))
register("merge_feeds", lambda s, d: offers.merge_feeds([
    market.market_offers(s, d).where(F.col("source") == x).drop(*(["currency"] if x == "Jumia" else []))
    for x in ["Jumia", "Amazon", "AliExpress"]]).select("id", "link", "source", "currency"))


# --- single operators -------------------------------------------------------------------------


@query
def neighbour_eps(spark: SparkSession, sf: str) -> DataFrame:
    """A high percentile of the distance to the fifth neighbour, over all prices."""
    eps = segments.neighbour_eps(laptops(spark, sf), 5, 99.9, 0.0)
    return spark.range(1).select(numeric.half_even(F.lit(eps), 9).alias("eps"))


@query
def usable_features(spark: SparkSession, sf: str) -> DataFrame:
    known = laptops(spark, sf).withColumn("rare", F.when(F.col("id") % 9 == 0, F.lit(1)))
    names = scaling.usable_features(known, ["ram_gb", "storage_gb", "cpu_generation", "rare", "absent"])
    return spark.createDataFrame(list(enumerate(names)), "place int, feature string")


register("truth_flags", lambda s, d: market.market_offers(s, d).select("id", features.truth_text(F.element_at(F.array(*[
    F.lit(x) for x in ["true", " YES ", "1", "no", None, "True", "0", ""]]), (F.col("id") % 8 + 1).cast("int"))).alias("flag")))


@query
def crawl_export(spark: SparkSession, sf: str) -> DataFrame:
    """Offers written as JSON by a crawl, read back."""
    columns = ["id", "title", "price", "currency", "source", "link", "page"]
    df = market.market_offers(spark, sf).select(*columns)
    folder = shared_folder(spark, "crawl-json")
    offers.write_json(df, folder)
    return spark.read.schema(df.schema).json(folder)


@query
def accessories_preferred(spark: SparkSession, sf: str) -> DataFrame:
    """Accessories of the exported CSV, which goes before the table; without a CSV the table's."""
    table = market.market_accessories(spark, sf)
    text = {c: F.lit("") for c in offers.ACCESSORY_CSV.fieldNames() if c not in table.columns}
    exported = table.where("in_stock").withColumns(text).select(*[F.col(c).cast("string") for c in offers.ACCESSORY_CSV.fieldNames()])
    folder = shared_folder(spark, "accessory-csv")
    offers.write_csv(exported, folder)
    found = [offers.load_accessories(spark, path, table) for path in (folder, f"{folder}-none")]
    parts = [df.select(F.lit(name).alias("origin"), "category", F.col("price").try_cast("double").alias("price")) for name, df in zip(["csv", "table"], found)]
    return parts[0].unionByName(parts[1]).groupBy("origin", "category").agg(
        F.count(F.lit(1)).alias("rows"), numeric.half_even(F.sum("price"), 2).alias("total"))


# what holds for every result of an operator that draws at random


@query
def kmeans_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, segments, segments whose price range meets the next one's, and names in the order of prices."""
    found = segments.kmeans_segments(laptops(spark, sf), restarts=2)
    ranges = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("a"), F.max("price").alias("z"))
    listed = ranges.agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("a", "z", "cluster"))).alias("r"))  # five rows
    pairs = F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda x, y: (x["z"] >= y["a"]).cast("int"))
    return listed.select("rows", F.size("r").alias("segments"), F.aggregate(pairs, F.lit(0), lambda a, b: a + b).alias("meeting"), F.array_join("r.cluster", ", ").alias("names"))


@query
def forest_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, whether 1 to 5 % are flagged, whether scores lie between -1 and 0, and flagged rows with a score above another's."""
    found = iforest.detect_isolation_forest(vectored(spark, sf))
    score, flag = F.col("anomaly_iforest_score"), F.col("anomaly_iforest")
    flagged, rows = F.count_if(flag), F.count(F.lit(1))
    return found.agg(
        rows.alias("rows"), ((flagged >= 0.01 * rows) & (flagged <= 0.05 * rows + 1)).alias("share_holds"), ((F.min(score) >= -1) & (F.max(score) <= 0)).alias("scores_hold"),
        (F.max(F.when(flag, score)) <= F.min(F.when(~flag, score)) + 1e-4).alias("flagged_lie_below"))


@query
def pca_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, and whether the components are centred, uncorrelated and ordered by their variance."""
    found = projection.pca_scatter(segments.price_bands(featured(spark, sf, "title", "price", "brand_detected", *VECTOR)))
    x, y = F.var_samp("x"), F.var_samp("y")
    return found.agg(
        F.count(F.lit(1)).alias("rows"), ((F.abs(F.avg("x")) < 1e-3) & (F.abs(F.avg("y")) < 1e-3)).alias("centred"),
        (F.abs(F.covar_samp("x", "y")) < 1e-4 * F.sqrt(x * y)).alias("uncorrelated"), (x >= y).alias("ordered"))


@query
def report_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report as one JSON document, by its keys."""
    numbers = market.market_offers(spark, sf).withColumn("price", prices.marketplace_price(F.col("price")))
    results = report.market_report(numbers, market.market_accessories(spark, sf), restarts=2)
    return report.payload_keys(report.payload(results))
