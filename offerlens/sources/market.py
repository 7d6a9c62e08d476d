"""Offer tables derived from the star-schema test tables.

The statements are plain SQL that several engines run alike; the scans behind
them read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

TITLE = """concat(
    CASE l.l_partkey % 12 WHEN 0 THEN 'HP EliteBook 840' WHEN 1 THEN 'Dell Latitude 5490' WHEN 2 THEN 'Lenovo ThinkPad T480'
      WHEN 3 THEN 'Asus ROG Strix G16 gaming' WHEN 4 THEN 'MacBook Air M2' WHEN 5 THEN 'Acer Nitro 5 GTX 1650'
      WHEN 6 THEN 'MSI Katana RTX 4070' WHEN 7 THEN 'Surface Laptop  tactile' WHEN 8 THEN 'Chuwi HeroBook notebook'
      WHEN 9 THEN 'Souris Logitech sans fil' WHEN 10 THEN 'Support stand aluminium' ELSE 'Cle USB flash drive' END, ' ',
    CASE l.l_suppkey % 7 WHEN 0 THEN 'Core i5-1135G7' WHEN 1 THEN 'Core i7 11th gen' WHEN 2 THEN 'Ryzen 7' WHEN 3 THEN 'Celeron N4020'
      WHEN 4 THEN 'Core Ultra 9' WHEN 5 THEN 'i3 reconditionne grade A' ELSE '' END, ' ',
    CASE l.l_linenumber % 6 WHEN 0 THEN '8Go RAM 256Go SSD' WHEN 1 THEN '256Go SSD 16Go' WHEN 2 THEN '8192Mo 512 SSD'
      WHEN 3 THEN '32GB DDR5 1To NVMe' WHEN 4 THEN '4GB 64GB eMMC' ELSE '' END)"""

SHARED = """CASE l.l_linenumber % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'usd' WHEN 2 THEN '' WHEN 3 THEN 'inconnu' ELSE 'MAD' END AS currency,
  p.p_brand AS brand,
  CASE l.l_suppkey % 3 WHEN 0 THEN 'Jumia' WHEN 1 THEN 'Amazon' ELSE 'AliExpress' END AS source,
  concat('https://shop.example/item/', CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING)) AS link,
  CASE l.l_partkey % 4 WHEN 0 THEN 'pc gamer' WHEN 1 THEN 'laptop' WHEN 2 THEN 'macbook' ELSE 'hp laptop' END AS search_query,
  CAST(l.l_quantity AS INT) AS page,
  l.l_returnflag = 'R' AS is_gaming,
  l.l_shipdate AS date_scraped
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""

OFFERS_SQL = f"""
SELECT l.l_orderkey * 10 + l.l_linenumber AS id,
  {TITLE} AS title,
  CASE l.l_linenumber % 4 WHEN 0 THEN CAST(l.l_extendedprice AS STRING)
    WHEN 1 THEN replace(CAST(l.l_extendedprice AS STRING), '.', ',')
    WHEN 2 THEN concat(CAST(CAST(floor(l.l_extendedprice / 1000) AS INT) AS STRING), '.', lpad(CAST(CAST(floor(l.l_extendedprice) AS INT) % 1000 AS STRING), 3, '0'), ',50')
    ELSE concat('MAD ', CAST(l.l_extendedprice AS STRING)) END AS price,
  {SHARED}"""

BAG_TITLE = """concat(CASE id % 5 WHEN 0 THEN 'Sacoche' WHEN 1 THEN 'Housse' WHEN 2 THEN 'Pochette' WHEN 3 THEN 'Laptop Backpack' ELSE 'Film' END, ' ', title)"""

BAGS_SQL = f"""
SELECT id, {BAG_TITLE} AS title, price, currency, brand, source, link, search_query, page, is_gaming, date_scraped FROM ({OFFERS_SQL}) o"""

ACCESSORIES_SQL = f"""
SELECT l.l_orderkey * 10 + l.l_linenumber AS id,
  CASE l.l_partkey % 4 WHEN 0 THEN 'Souris' WHEN 1 THEN 'stand' WHEN 2 THEN 'usb' ELSE 'sac_laptop' END AS category,
  {TITLE} AS title,
  CAST(l.l_extendedprice / 64 AS STRING) AS price,
  l.l_linestatus = 'O' AS in_stock,
  {SHARED}"""

PRODUCTS_SQL = """
SELECT p_partkey AS product_id, p_name AS title, p_type AS category, p_brand AS platform FROM part"""

PRICES_SQL = """
SELECT l_partkey AS product_id, l_orderkey AS search_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
  l_shipdate AS scraped_at FROM lineitem"""

SEARCHES_SQL = """
SELECT o_orderkey AS search_id, o_custkey AS user_id, o_orderpriority AS query, o_orderstatus AS status,
  o_orderdate AS created_at FROM orders"""

ALERTS_SQL = """
SELECT o_orderkey AS alert_id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(12,2)) AS target_price,
  o_orderstatus = 'O' AS is_active FROM orders"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register test tables as views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    tables(spark, sf_dir, *names)
    return spark.sql(sql)


def market_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, OFFERS_SQL, "lineitem", "part")


def bag_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers as bags, sleeves and other things for what their titles name."""
    tables(spark, sf_dir, "lineitem", "part")
    return spark.sql(BAGS_SQL)


def offer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``market_offers`` as a stream over the files that are there now."""
    tables(spark, sf_dir, "part", "lineitem")
    schema = spark.table("lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    lines.createOrReplaceTempView("lineitem")
    return spark.sql(OFFERS_SQL)


def market_accessories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ACCESSORIES_SQL, "lineitem", "part")


def market_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PRODUCTS_SQL, "part")


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PRICES_SQL, "lineitem")


def market_search_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with title and platform of their product."""
    products = market_products(spark, sf_dir).select("product_id", "title", "platform")
    return market_prices(spark, sf_dir).join(products, "product_id")


def market_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SEARCHES_SQL, "orders")


def market_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ALERTS_SQL, "orders")


def price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations: one key per user of the event table."""
    return _view(
        spark, sf_dir, "SELECT event_id, user_id, ts, value AS price FROM events WHERE value IS NOT NULL", "events"
    )
