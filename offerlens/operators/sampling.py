"""Samples that are a feature of a chart or report, in a reproducible hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def hash_key(columns: list[str], seed: int = 42) -> Column:
    """Order key of a row: a digest of the seed and the row's columns."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary"))


def hash_sample(df: DataFrame, size: int, columns: list[str], seed: int = 42) -> DataFrame:
    """``size`` rows in hash order: a bounded top-k per task, then one merge."""
    ordered = df.withColumn("_h", hash_key(columns, seed))
    rest = [c for c in df.columns if c not in columns]
    return ordered.orderBy("_h", *columns, *rest).limit(size).drop("_h")


def numbered(df: DataFrame, size: int, columns: list[str], seed: int = 42) -> DataFrame:
    """Hash sample with row numbers 1..size; the numbering window only sees the bounded sample."""
    sample = hash_sample(df, size, columns, seed).withColumn("_h", hash_key(columns, seed))
    order = Window.partitionBy().orderBy("_h", *df.columns)
    return sample.withColumn("row", F.row_number().over(order)).drop("_h")


def all_numbered(df: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """All rows with numbers 1..n in hash order.

    Rows are numbered inside 4096 ranges of the hash and shifted by the ranges' totals, so no task numbers them all.
    """
    keyed = df.withColumn("_h", hash_key(columns, seed)).withColumn("_b", F.substring("_h", 1, 3))
    lower = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_off"))
    rest = [c for c in df.columns if c not in columns]
    inside = Window.partitionBy("_b").orderBy("_h", *columns, *rest)
    return keyed.withColumn("_i", F.row_number().over(inside)).join(offsets, "_b").withColumn("row", F.col("_off") + F.col("_i")).select(*df.columns, "row")


def paired(left: DataFrame, right: DataFrame, size: int | None, identity: list[str], seed: int = 42) -> DataFrame:
    """Row i of one table beside row i of the other in hash order, of all rows or of samples of ``size``.

    ``identity`` names the columns that tell rows apart; they are dropped.
    """
    def placed(df: DataFrame) -> DataFrame:
        names = [c for c in identity if c in df.columns]
        return (all_numbered(df, names, seed) if size is None else numbered(df, size, names, seed)).drop(*identity)

    return placed(left).join(placed(right), "row").drop("row")


def every_nth(df: DataFrame, about: int, order: list[str]) -> DataFrame:
    """Every ⌈n/about⌉-th row in order, for order columns of any type.

    Rows are split into as many ranges of the order as there are shuffle
    partitions and numbered inside; the ranges' totals shift the numbers. The
    ranges come from a sample, so they are written once before they are counted.
    """
    ranked = [*order, *[c for c in df.columns if c not in order]]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = materialize(df.repartitionByRange(ranges, *ranked).withColumn("_b", F.spark_partition_id()))
    totals = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range, however many rows the table has
    lower = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_b", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_b").orderBy(*ranked)
    placed = keyed.withColumn("_i", F.row_number().over(inside)).join(offsets, "_b")
    step = F.ceil(F.col("_all") / about)
    return placed.where((F.col("_off") + F.col("_i") - 1) % step == 0).select(*df.columns)
