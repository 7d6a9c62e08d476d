"""Exact quantiles, ranks and histograms without a single-task sort.

Rows are first collapsed to (key, value, count), which combines on the map
side. Values fall into buckets of about 0.1 % relative width; running counts
are taken inside each (key, bucket) and shifted by the counts of the lower
buckets, a table of a few thousand rows per key. No task ever sees a whole
key, however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import half_even
from ..session import stored

BUCKETS_PER_E = 1024.0


def value_bucket(value: Column) -> Column:
    """Monotone bucket number of a double."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(BUCKETS_PER_E)).cast("bigint")


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, v, c): distinct values with their row counts; missing keys and values drop out.

    They are written once, so that what reads them more than once does not read the rows again.
    """
    count = F.sum("_w") if weight else F.count(F.lit(1))
    rows = known_rows(df, keys, value, weight).where(~F.isnan("v"))
    return stored(rows.groupBy(*keys, "v").agg(count.alias("c")), "value-counts")


def known_rows(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, v) of rows without a missing key or value.

    The columns pass through a generator of one row, so that a computed key is read by the filter, not computed again.
    """
    columns = [*keys, F.col(value).cast("double").alias("v"), *([F.col(weight).alias("_w")] if weight else [])]
    rows = df.select(F.explode(F.array(F.struct(*columns))).alias("_r")).select("_r.*")
    for column in [*keys, "v"]:
        rows = rows.where(F.col(column).isNotNull())
    return rows


def running_counts(counts: DataFrame, keys: list[str], sums: bool = False) -> DataFrame:
    """Add ``before`` (rows with a lower value in the key) and ``n`` (rows of the key).

    With ``sums`` also ``sum_before`` and ``sum_n`` of value times count.
    """
    counts = counts.withColumn("_b", value_bucket(F.col("v")))
    inside = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    measures = {"before": F.col("c")}
    if sums:
        measures["sum_before"] = F.col("v") * F.col("c")
    totals = {"before": "n", "sum_before": "sum_n"}

    buckets = counts.groupBy(*keys, "_b").agg(*[F.sum(m).alias(f"_{name}") for name, m in measures.items()])
    for name in measures:
        buckets = buckets.withColumn(f"_off_{name}", F.coalesce(F.sum(f"_{name}").over(lower), F.lit(0)))
        buckets = buckets.withColumn(totals[name], F.sum(f"_{name}").over(whole))
    buckets = buckets.drop(*[f"_{name}" for name in measures])

    for name, m in measures.items():
        counts = counts.withColumn(name, F.coalesce(F.sum(m).over(inside), F.lit(0)))
    joined = counts.join(buckets, [*keys, "_b"])
    for name in measures:
        joined = joined.withColumn(name, F.col(name) + F.col(f"_off_{name}"))
    return joined.drop("_b", *[f"_off_{name}" for name in measures])


def _marks(wanted: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over running counts that pick the neighbours of each quantile, and the quantiles from them and ``_n``."""
    first, after, v = F.col("before"), F.col("before") + F.col("c"), F.col("v")
    picks, results = [], []
    for name, q in wanted.items():
        place = (F.col("n") - 1) * F.lit(float(q))
        low = F.floor(place)
        high = F.least(low + 1, F.col("n") - 1)
        picks += [
            F.max(F.when((first <= low) & (low < after), v)).alias(f"_lo_{name}"),
            F.max(F.when((first <= high) & (high < after), v)).alias(f"_hi_{name}"),
        ]
        part = (F.col("_n") - 1) * F.lit(float(q)) - F.floor((F.col("_n") - 1) * F.lit(float(q)))
        results.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part).alias(name))
    return picks, results


def summaries(df: DataFrame, keys: list[str], value: str, moments: list[str], wanted: dict[str, float]) -> DataFrame:
    """Moments and exact quantiles per key of a floating column, in one pass over the rows.

    Rows collapse to distinct values with counts; moments are taken around the key's mean, which the table of
    buckets knows. NaN counts as the highest value in moments and is left out of quantiles, and keys with nothing else drop out.
    """
    counts = stored(known_rows(df, keys, value).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")), "value-counts")
    v, c = F.col("v"), F.col("c")
    counts = counts.withColumn("_b", F.when(F.isnan(v), F.lit(2**40)).otherwise(value_bucket(v)))
    inside = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    buckets = counts.groupBy(*keys, "_b").agg(
        F.sum(F.when(~F.isnan(v), c)).alias("_c"), F.sum(c).alias("_rows"), F.sum(v * c).alias("_sum"), F.min(v).alias("_min"), F.max(v).alias("_max"))
    buckets = buckets.select(
        *keys, "_b", F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_off"), F.sum("_c").over(whole).alias("n"), F.sum("_rows").over(whole).alias("_all"),
        F.sum("_sum").over(whole).alias("_total"), F.min("_min").over(whole).alias("_low"), F.max("_max").over(whole).alias("_high"))
    # between the ends also after rounding, so equal values have no spread
    buckets = buckets.withColumn("_mean", F.least(F.greatest(F.col("_total") / F.col("_all"), F.col("_low")), F.col("_high")))
    ranked = counts.withColumn("before", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(buckets, [*keys, "_b"])
    ranked = ranked.withColumn("before", F.col("before") + F.col("_off"))
    picks, results = _marks(wanted)
    d, rows = v - F.col("_mean"), F.col("_rows")
    picked = ranked.groupBy(*keys).agg(
        F.max("n").alias("_n"), F.coalesce(F.sum(c), F.lit(0)).alias("_rows"), F.max("_mean").alias("_mean"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.sum(c * d * d).alias("_m2"), F.sum(c * d * d * d).alias("_m3"), F.sum(c * d * d * d * d).alias("_m4"), *picks)
    if keys:
        picked = picked.where(F.col("_n") > 0)
    m2 = F.nullif(F.col("_m2"), F.lit(0.0))
    known = {
        "count": rows, "mean": F.col("_mean"), "std": F.when(rows > 1, F.sqrt(F.col("_m2") / (rows - 1))), "min": F.col("_min"), "max": F.col("_max"),
        "skewness": F.sqrt(rows) * F.col("_m3") / F.sqrt(m2 * m2 * m2), "kurtosis": rows * F.col("_m4") / (m2 * m2) - 3.0,
    }
    return picked.select(*keys, *[known[m].alias(m) for m in moments], *results)


def quantiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linearly interpolated exact quantiles per key, one column per wanted name."""
    ranked = running_counts(value_counts(df, keys, value, weight), keys)
    picks, results = _marks(wanted)
    picked = ranked.groupBy(*keys).agg(F.max("n").alias("_n"), *picks)
    return picked.select(*keys, *results)


def attach(df: DataFrame, row: DataFrame, name: str = "_q") -> DataFrame:
    """Add a one-row table as a struct column: a scalar subquery, planned and run once."""
    return df.withColumn(name, row.select(F.struct("*")).scalar())


def average_ranks(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``rank``: the mean 1-based rank of each distinct value in its key."""
    return running_counts(counts, keys).withColumn("rank", F.col("before") + (F.col("c") + 1) / 2)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over the range, the last closed: (bin, lo, hi, count), empty bins included.

    A constant column widens its range by 0.5 on both sides.
    """
    spark = df.sparkSession
    data = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).alias("v"))
    ends = data.agg(F.min("v").alias("a"), F.max("v").alias("z"))
    flat = F.col("a") == F.col("z")
    ends = ends.select(
        F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"),
        F.when(flat, F.col("z") + 0.5).otherwise(F.col("z")).alias("z"),
    )
    a, z = F.col("ends.a"), F.col("ends.z")

    def edge(i: Column) -> Column:
        return F.when(i == bins, z).otherwise(a + i * ((z - a) / bins))

    placed = attach(data, ends, "ends")
    guess = F.least(F.floor((F.col("v") - a) / (z - a) * bins), F.lit(bins - 1))
    placed = placed.withColumn("i", guess)
    i = F.col("i")
    exact = F.when(F.col("v") < edge(i), i - 1).when((F.col("v") >= edge(i + 1)) & (i < bins - 1), i + 1).otherwise(i)
    counted = placed.select(exact.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    frame = attach(spark.range(0, bins, 1, 1).withColumnRenamed("id", "bin"), ends, "ends")
    return (
        frame.where(F.col("ends.a").isNotNull())
        .join(counted, "bin", "left")
        .select(
            "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
            F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        )
    )


def range_label(lo: Column, hi: Column, suffix: str = "") -> Column:
    """"1,200–3,400": both ends cut to whole numbers."""
    def whole(x: Column) -> Column:
        return F.format_number(x.cast("bigint"), 0)

    return F.concat(whole(lo), F.lit("–"), whole(hi), F.lit(suffix))


def price_distribution(df: DataFrame, bins: int = 12) -> DataFrame:
    """Histogram with labels, edges and shares."""
    rows = histogram(df, "price", bins)
    share = F.col("count") / F.sum("count").over(Window.partitionBy()) * 100
    return rows.select(
        "bin", range_label(F.col("lo"), F.col("hi")).alias("label"), F.rint("lo").alias("min"), F.rint("hi").alias("max"),
        "count", half_even(share, 2).alias("pourcentage"),
    )


def chart_distribution(df: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram for a chart, labels in MAD."""
    return histogram(df, "price", bins).select(
        "bin", range_label(F.col("lo"), F.col("hi"), " MAD").alias("label"), "count",
        half_even(F.col("lo"), 2).alias("min_price"), half_even(F.col("hi"), 2).alias("max_price"),
    )


def plain_histogram(df: DataFrame, bins: int = 12) -> DataFrame:
    """Histogram with labels and counts only."""
    return histogram(df, "price", bins).select("bin", range_label(F.col("lo"), F.col("hi")).alias("label"), "count")
