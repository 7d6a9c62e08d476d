"""Reading and writing offer tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions import prices
from ..functions.numeric import strip
from ..operators.clean import load_bounds

TEXT = T.StringType()
LAPTOP_CSV = T.StructType([
    T.StructField(c, TEXT) for c in [
        "title", "price", "currency", "brand", "source", "link", "image", "search_query", "page", "is_gaming",
        "date_scraped",
    ]
])
ACCESSORY_CSV = T.StructType([
    T.StructField(c, TEXT) for c in [
        "category", "title", "price", "old_price", "brand", "source", "link", "image", "search_query", "page",
        "in_stock", "is_gaming", "date_scraped",
    ]
])
OFFERS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", TEXT), T.StructField("price", T.DoubleType()),
    T.StructField("currency", TEXT), T.StructField("brand", TEXT), T.StructField("source", TEXT),
    T.StructField("link", TEXT), T.StructField("image", TEXT), T.StructField("search_query", TEXT),
    T.StructField("page", T.IntegerType()), T.StructField("is_gaming", T.BooleanType()),
    T.StructField("date_scraped", T.TimestampType()),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


class CsvRead(NamedTuple):
    """Rows of a CSV file, the lines that are none (columns as far as they were read, ``line``, ``reason``), and how many there were.

    ``counts`` is filled by the first action over ``rows``: ``lines`` and ``rejected``.
    """

    rows: DataFrame
    rejected: DataFrame
    counts: Observation


def read_csv_lines(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False, header: bool = True) -> CsvRead:
    """CSV with quotes. A line with too many fields, or with a quote that does not close, is rejected; one with too few is filled up with nulls.

    Whether a line is rejected does not depend on the columns that a query selects. With ``multi_line`` quoted values may hold
    line breaks; a file is then read by one task. A byte order mark before the header does no harm: columns go by place. A
    missing file is an empty one.
    """
    whole = T.StructType([*schema.fields, T.StructField("line", TEXT)])
    if path_exists(spark, path):
        # without pruning every query sees all fields of a line, and so the same malformed ones
        lines = spark.read.option("columnPruning", False).csv(
            path, header=header, schema=whole, mode="PERMISSIVE", columnNameOfCorruptRecord="line", enforceSchema=True, quote='"', escape='"',
            multiLine=multi_line,
        )
    else:
        lines = spark.createDataFrame([], whole)
    # Spark reads no raw lines on their own, so they come with a column
    lines = lines.withColumn("line", F.concat("line", F.substring(F.coalesce(F.col(schema.fieldNames()[0]), F.lit("")), 1, 0)))
    # a malformed line once more with a mark behind it: it has too few fields if the mark takes the place of one
    mark, names = "\u0001", ", ".join(f"f{i} string" for i in range(len(schema)))
    fields = F.from_csv(F.concat("line", F.lit("," + mark)), names, {"quote": '"', "escape": '"'})
    short = F.array_contains(F.array(*[F.coalesce(fields[f"f{i}"], F.lit("")) for i in range(len(schema))]), mark)
    odd_quotes = F.length(F.translate("line", '"', "")) % 2 != F.length("line") % 2
    reason = F.when(F.col("line").isNull(), None).when(odd_quotes, "open quote").when(~short, "too many fields")
    judged = lines.withColumn("reason", reason)
    counts = Observation()
    rows = judged.observe(counts, F.count(F.lit(1)).alias("lines"), F.count("reason").alias("rejected"))
    return CsvRead(rows.where("reason IS NULL").drop("line", "reason"), judged.where("reason IS NOT NULL"), counts)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False, header: bool = True) -> DataFrame:
    """The rows of ``read_csv_lines``."""
    return read_csv_lines(spark, path, schema, multi_line, header).rows


def load_laptops(offers: DataFrame) -> DataFrame:
    """Laptop offers within the load bounds; the bounds apply before currency conversion."""
    return load_bounds(offers)


def load_accessories(spark: SparkSession, csv_path: str | None, table: DataFrame) -> DataFrame:
    """Accessories from the exported CSV when there is one, else from the table."""
    if csv_path and path_exists(spark, csv_path):
        return read_csv(spark, csv_path, ACCESSORY_CSV)
    return table


def _text_or(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def _flag(column: str) -> Column:
    return F.coalesce(F.lower(strip(F.col(column))) == "true", F.lit(False))


def _page() -> Column:
    return F.coalesce(F.col("page").try_cast("int"), F.lit(1))


def import_laptops(raw: DataFrame) -> DataFrame:
    """Typed laptop offers from CSV text columns, ready for the upsert."""
    return raw.select(
        "title", prices.offer_insert_price(F.col("price")).alias("price"),
        F.coalesce("currency", F.lit("")).alias("currency"), F.substring("brand", 1, 50).alias("brand"),
        "source", "link", "image", "search_query", _page().alias("page"), _flag("is_gaming").alias("is_gaming"),
        F.try_to_timestamp("date_scraped").alias("date_scraped"),
    )


def import_accessories(raw: DataFrame) -> DataFrame:
    """Typed accessory offers from CSV text; rows with a bad price are skipped."""
    price = prices.accessory_insert_price(F.col("price"))
    return raw.withColumn("_price", price).where(F.col("_price").isNotNull()).select(
        _text_or("category", "mouse").alias("category"), "title", F.col("_price").alias("price"),
        F.lit("EUR").alias("currency"), F.nullif(F.col("old_price"), F.lit("")).alias("old_price"),
        _text_or("brand", "Inconnu").alias("brand"), "source", "link", "image", "search_query",
        _page().alias("page"), _flag("in_stock").alias("in_stock"), _flag("is_gaming").alias("is_gaming"),
        F.try_to_timestamp("date_scraped").alias("date_scraped"),
    )


def refresh_offers(raw: DataFrame) -> DataFrame:
    """Typed offers for the table refresh, with its own defaults and price rule."""
    return raw.select(
        _text_or("title", "Sans titre").alias("title"), prices.refresh_price(F.col("price")).alias("price"),
        _text_or("currency", "MAD").alias("currency"), _text_or("brand", "Inconnu").alias("brand"),
        _text_or("source", "AliExpress").alias("source"), "link", "image", "search_query", _page().alias("page"),
        _flag("is_gaming").alias("is_gaming"), F.try_to_timestamp("date_scraped").alias("date_scraped"),
    )


def merge_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Offers of several shops in one frame; columns a shop lacks are null."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


EXPORT_COLUMNS = ["title", "price", "brand_detected", "source", "price_category", "ram_gb", "storage_gb", "is_gaming"]


def export_rows(df: DataFrame) -> DataFrame:
    """The exported columns, those that exist, as text with '' for missing values."""
    names = [c for c in EXPORT_COLUMNS if c in df.columns]
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_clean(laptops: DataFrame, accessories: DataFrame, folder: str) -> None:
    """Both cleaned tables, by shop, so that later scans prune."""
    laptops.write.mode("overwrite").partitionBy("source").parquet(f"{folder}/products")
    accessories.write.mode("overwrite").partitionBy("source").parquet(f"{folder}/accessories_cleaned")
