"""Price statistics by group, rank tests and correlations."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..dims import ANOMALY_BANDS, PRICE_LEVEL_ORDER
from ..functions.numeric import half_even
from ..session import stored
from .distribution import attach, average_ranks, quantiles, summaries

MOMENTS = {
    "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    "skewness": F.skewness, "kurtosis": F.kurtosis,
}


def group_stats(
    df: DataFrame, keys: list[str], moments: list[str], wanted: dict[str, float], value: str = "price",
    digits: int | None = 2,
) -> DataFrame:
    """Moments and exact quantiles per key; rows with a missing key are left out."""
    if isinstance(df.schema[value].dataType, DoubleType):
        both = summaries(df, keys, value, moments, wanted)
    else:  # minima and means in the column's own type
        data = df.where(F.col(value).isNotNull())
        for key in keys:
            data = data.where(F.col(key).isNotNull())
        basic = data.groupBy(*keys).agg(*[MOMENTS[m](value).alias(m) for m in moments])
        marks = quantiles(data, keys, value, wanted)
        if keys:
            both = basic.join(marks, keys)
        else:
            both = attach(basic, marks).select(*moments, *[F.col(f"_q.{name}").alias(name) for name in wanted])
    if digits is None:
        return both
    rounded = {c: half_even(F.col(c), digits) for c in [*moments, *wanted] if c != "count"}
    return both.withColumns(rounded)


def variation(std: Column, mean: Column) -> Column:
    """Standard deviation in percent of the mean, 0 for mean 0."""
    return F.when(mean == 0, F.lit(0.0)).otherwise(half_even(std / mean * 100, 2))


def descriptive_stats(df: DataFrame, value: str = "price") -> DataFrame:
    """One row of descriptive statistics; no row for no prices."""
    raw = group_stats(
        df, [], ["count", "mean", "std", "min", "max", "skewness", "kurtosis"],
        {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9}, value, digits=None,
    ).where(F.col("count") > 0)
    two = [half_even(F.col(c), 2).alias(c) for c in ["mean", "median", "std", "min", "max", "p25", "p75", "p90"]]
    return raw.select(
        "count", *two, half_even(F.col("p75") - F.col("p25"), 2).alias("iqr"),
        half_even(F.col("skewness"), 4).alias("skewness"), half_even(F.col("kurtosis"), 4).alias("kurtosis"),
        variation(F.col("std"), F.col("mean")).alias("cv"),
    )


def price_percentiles(df: DataFrame, value: str = "price") -> DataFrame:
    wanted = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    return group_stats(df, [], ["count", "mean", "std"], wanted, value).where(F.col("count") > 0).drop("count")


def brand_column(df: DataFrame) -> str:
    return "brand_detected" if "brand_detected" in df.columns else "brand"


def stats_by_brand(df: DataFrame) -> DataFrame:
    """Per brand, most offers first."""
    key = brand_column(df)
    rows = group_stats(
        df, [key], ["count", "mean", "std", "min", "max"], {"median": 0.5, "p25": 0.25, "p75": 0.75}
    )
    return rows.select(
        key, "count", "mean", "median", "std", "min", "max", "p25", "p75",
        half_even(F.col("std") / F.col("mean") * 100, 2).alias("cv"),
    ).orderBy(F.desc("count"), key)


def stats_by_category(df: DataFrame) -> DataFrame:
    """Per price level, from the lowest to the highest level present."""
    rows = group_stats(df, ["price_category"], ["count", "mean", "min", "max"], {"median": 0.5})
    place = F.array_position(F.array(*[F.lit(x) for x in PRICE_LEVEL_ORDER]), F.col("price_category"))
    known = rows.where(F.col("price_category").isin(PRICE_LEVEL_ORDER))
    return known.select("price_category", "count", "mean", "median", "min", "max").orderBy(place)


def stats_by_source(df: DataFrame, at_least: int = 3) -> DataFrame:
    """Per shop with enough prices, by median."""
    rows = group_stats(
        df, ["source"], ["count", "mean", "std", "min", "max"], {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ).where(F.col("count") >= at_least)
    return rows.select("source", "count", "min", "q1", "median", "mean", "q3", "max", "std").orderBy("median", "source")


def boxplot_by_source(df: DataFrame, with_std: bool = False) -> DataFrame:
    """Per shop, unrounded but for the mean (and the deviation)."""
    moments = ["count", "mean", "min", "max"] + (["std"] if with_std else [])
    rows = group_stats(df, ["source"], moments, {"q1": 0.25, "median": 0.5, "q3": 0.75}, digits=None)
    rows = rows.withColumn("mean", half_even(F.col("mean"), 2))
    names = ["source", "count", "min", "q1", "median", "mean", "q3", "max"]
    if with_std:
        rows = rows.withColumn("std", half_even(F.col("std"), 2))
        names.append("std")
    return rows.select(*names).orderBy("source")


def brand_bar(df: DataFrame, top: int = 10) -> DataFrame:
    """Brands with the most offers."""
    key = brand_column(df)
    rows = group_stats(df, [key], ["count", "mean"], {"median": 0.5})
    return rows.select(key, "count", "mean", "median").orderBy(F.desc("count"), key).limit(top)


def brand_chart(df: DataFrame, top: int = 8) -> DataFrame:
    key = brand_column(df)
    return brand_bar(df, top).select(
        F.col(key).alias("brand"), "count", F.col("mean").alias("mean_price"), F.col("median").alias("median_price")
    )


def accessory_stats(df: DataFrame) -> DataFrame:
    """Per accessory category."""
    rows = group_stats(
        df, ["accessory_category"], ["count", "mean", "min", "max"], {"median": 0.5, "q1": 0.25, "q3": 0.75}
    )
    return rows.select(
        F.col("accessory_category").alias("category"), "count", "mean", "median", "min", "max", "q1", "q3"
    ).orderBy("category")


def search_stats(df: DataFrame, key: str = "search_id") -> DataFrame:
    """Price statistics of every search with at least two prices, all searches at once."""
    rows = group_stats(
        df, [key], ["count", "min", "max", "mean", "std"], {"median": 0.5, "q1": 0.25, "q3": 0.75}, digits=None
    ).where(F.col("count") >= 2)
    return rows.select(
        key, F.col("min").alias("min_price"), F.col("max").alias("max_price"), F.col("mean").alias("mean_price"),
        F.col("median").alias("median_price"), F.col("std").alias("std_price"), "q1", "q3", "count",
    )


def platform_distribution(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Prices per platform (and search)."""
    return df.groupBy(*(keys or []), "platform").agg(
        F.count("price").alias("count"), F.avg("price").alias("mean"), F.min("price").alias("min"),
        F.max("price").alias("max"),
    )


def gaming_groups(df: DataFrame) -> DataFrame:
    """Statistics of gaming and other offers, zeros for an empty group."""
    data = df.where(F.col("is_gaming").isNotNull()).withColumn(
        "group", F.when(F.col("is_gaming"), F.lit("gaming")).otherwise(F.lit("non_gaming"))
    )
    rows = group_stats(data, ["group"], ["count", "mean", "min", "max"], {"median": 0.5})
    both = df.sparkSession.range(0, 2, 1, 1).select(
        F.when(F.col("id") == 0, F.lit("gaming")).otherwise(F.lit("non_gaming")).alias("group")
    )
    zero = F.lit(0.0)
    return both.join(rows, "group", "left").select(
        "group", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        *[F.coalesce(c, zero).alias(c) for c in ["mean", "median", "min", "max"]],
    )


def rank_sums(df: DataFrame, value: str = "price", flag: str = "is_gaming") -> DataFrame:
    """One row for the rank test: n1, n2, statistic u1 and the tie sum of t^3 - t."""
    data = df.where(F.col(flag).isNotNull())
    inside = F.col(flag).cast("int").cast("bigint")
    counts = (
        data.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"), F.sum(inside).alias("c1"))
    )
    ranked = average_ranks(counts, [])
    c = F.col("c").cast("double")
    sums = ranked.agg(
        F.sum("c1").alias("n1"), F.sum(F.col("c") - F.col("c1")).alias("n2"),
        F.sum(F.col("rank") * F.col("c1")).alias("r1"), F.sum(c * c * c - c).alias("ties"),
    )
    return sums.select("n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u1"), "ties")


def _exact_u_pvalue(n1: int, n2: int, u: float) -> float:
    """Two-sided exact p-value without ties: number of arrangements per statistic value.

    The loop runs over the smaller group, of at most eight rows.
    """
    n1, n2 = sorted((n1, n2))
    ways = [1]
    for i in range(1, n1 + 1):
        # multiply the generating function by (1 - q^(n2+i)) / (1 - q^i)
        size = n2 * i + 1
        up = [(ways[j] if j < len(ways) else 0) - (ways[j - n2 - i] if 0 <= j - n2 - i < len(ways) else 0)
              for j in range(size)]
        for j in range(i, size):
            up[j] += up[j - i]
        ways = up
    top = max(u, n1 * n2 - u)
    tail = sum(ways[math.ceil(top):])
    return min(1.0, 2.0 * tail / sum(ways))


def _u_pvalue(n1: int, n2: int, u: float, ties: float) -> float:
    """Two-sided p-value of one rank test."""
    if min(n1, n2) <= 8 and ties == 0:
        return _exact_u_pvalue(n1, n2, u)
    n = n1 + n2
    spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    if spread == 0:
        return float("nan")
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread
    return min(1.0, math.erfc(z / math.sqrt(2)))


def mann_whitney(df: DataFrame, value: str = "price", flag: str = "is_gaming", at_least: int = 5) -> DataFrame:
    """Two-sided rank test of flagged against other rows: (statistic, pvalue, significant).

    Exact for up to 8 rows in a group without ties, else normal with tie and
    continuity correction. No row when a group is too small.
    """
    sums = rank_sums(df, value, flag).where((F.col("n1") >= at_least) & (F.col("n2") >= at_least))

    def tested(batches):
        for pdf in batches:
            p = [_u_pvalue(int(r.n1), int(r.n2), r.u1, r.ties) for r in pdf.itertuples()]
            yield pdf.assign(p=p)[["u1", "p"]]

    tests = sums.mapInPandas(tested, "u1 double, p double")
    return tests.select(
        half_even(F.col("u1"), 4).alias("statistic"), half_even(F.col("p"), 6).alias("pvalue"),
        (F.col("p") < 0.05).alias("significant"),
    )


CORRELATED = ["price", "log_price", "ram_gb", "storage_gb", "cpu_score", "price_per_gb_ram"]
SHORT_SIDE = 50_000  # values of a column whose ranks are sent to all tasks


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation (a, b, rho, n) of every column pair over the rows that have both.

    Rows collapse to distinct tuples, written once. A value's rank beside another column counts the rows that have both,
    so each column's values are counted by which columns are known with them, and ranked beside all others in one pass.
    The tuples meet a table of centred ranks per column (one that is short is sent to all tasks), and one aggregate has
    the sums of all pairs: no row is multiplied by the number of pairs. Missing values match nothing and are spread over all tasks.
    """
    at = range(len(columns))
    tuples = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).groupBy(*[f"v{i}" for i in at]).agg(F.count(F.lit(1)).alias("c"))
    tuples = stored(tuples, "rank-tuples")
    entries = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"v{i}").alias("v")) for i in at])
    known = F.array(*[F.col(f"v{i}").isNotNull() for i in at]).alias("known")
    values = tuples.select("c", known, F.explode(entries).alias("e")).select("c", "known", "e.*").where(F.col("v").isNotNull())
    values = values.groupBy("at", "v", "known").agg(F.sum("c").alias("c"))
    values = values.select("at", "v", "c", "known", F.explode(F.array(*[F.lit(i) for i in at])).alias("other")).where((F.col("other") != F.col("at")) & F.get("known", F.col("other")))
    values = stored(values.groupBy("at", "other", "v").agg(F.sum("c").alias("c")), "rank-values")
    centred = F.col("rank") - (F.col("n") + 1) / 2
    ranked = average_ranks(values, ["at", "other"]).groupBy("at", "v").agg(*[F.max(F.when(F.col("other") == i, centred)).alias(f"d{i}") for i in at])
    ranked = stored(ranked, "ranks")
    lengths = dict(ranked.groupBy("at").count().collect())  # a row per column

    both = tuples.withColumn("_spread", F.pmod(F.xxhash64(*[f"v{i}" for i in at]), F.lit(4096)) + 1)
    for i in at:
        side = ranked.where(F.col("at") == i).select(F.col("v").alias("_v"), F.lit(0).cast("bigint").alias("_k"), *[F.col(f"d{j}").alias(f"d{i}_{j}") for j in at])
        if lengths.get(i, 0) <= SHORT_SIDE:
            side = F.broadcast(side)
        key = F.when(F.col(f"v{i}").isNull(), F.col("_spread")).otherwise(F.lit(0))
        both = both.join(side, (F.coalesce(f"v{i}", F.lit(0.0)) == side["_v"]) & (key == side["_k"]), "left").drop("_v", "_k")
    sums = []
    for i, j in combinations(at, 2):
        dx, dy = F.col(f"d{i}_{j}"), F.col(f"d{j}_{i}")
        c = F.when(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull(), F.col("c"))  # rows with both
        sums.append(F.struct(
            F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy"), F.sum(c).alias("n")))
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return both.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*").where(F.col("n") > 0).select(
        "a", "b", F.when(spread > 0, F.col("xy") / spread).alias("rho"), "n")


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Rank correlation matrix of price and size columns, one row per column."""
    columns = [c for c in CORRELATED if c in df.columns]
    pairs = spearman_pairs(df, columns).select("a", "b", half_even(F.col("rho"), 4).alias("rho"))
    mirrored = pairs.union(pairs.select(F.col("b"), F.col("a"), "rho"))
    wide = mirrored.groupBy(F.col("a").alias("feature")).pivot("b", columns).agg(F.first("rho"))
    return wide.select(
        "feature", *[F.when(F.col("feature") == c, F.lit(1.0)).otherwise(F.col(c)).alias(c) for c in columns]
    )


def run_summary(df: DataFrame, sources: list[str]) -> DataFrame:
    """Per crawl query: offers per shop, total scraped and inserted, status by the ``stopped`` flag."""
    counts = [F.count_if(F.col("source") == s).alias(f"{s.lower()}_count") for s in sources]
    stopped = F.max("stopped") if "stopped" in df.columns else F.lit(False)
    return df.groupBy("search_query").agg(
        *counts, F.count(F.lit(1)).alias("total_scraped"), F.count(F.lit(1)).alias("inserted"),
        F.when(stopped, F.lit("stopped")).otherwise(F.lit("success")).alias("status"),
    )


def currency_audit(df: DataFrame) -> DataFrame:
    """Rows in USD, in MAD and in none of USD, MAD and EUR; missing currencies count nowhere."""
    c = F.col("currency")
    return df.agg(
        F.count_if(c == "USD").alias("usd"), F.count_if(c == "MAD").alias("mad"),
        F.count_if(~c.isin("USD", "MAD", "EUR")).alias("other"),
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Facet: distinct non-empty values with their counts."""
    return df.where(F.col(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def anomaly_bands(df: DataFrame) -> DataFrame:
    """Rows per chart price band, empty bands included."""
    bands = [
        F.struct(F.lit(i).alias("band"), F.lit(label).alias("label"),
                 F.count_if((F.col("price") >= a) & (F.col("price") < z)).alias("count"))
        for i, (label, a, z) in enumerate(ANOMALY_BANDS)
    ]
    return df.agg(F.array(*bands).alias("bands")).select(F.explode("bands").alias("x")).select("x.*")


def dashboard(df: DataFrame, flag: str) -> DataFrame:
    """One row: offers, median price, brands and anomalies."""
    brands = brand_column(df)
    median = quantiles(df, [], "price", {"median": 0.5}).scalar()
    return df.agg(
        F.count("price").alias("offers"), F.count_distinct(brands).alias("brands"), F.count_if(F.col(flag)).alias("anomalies")
    ).select("offers", half_even(median, 2).alias("median_price"), "brands", "anomalies")


def radar(df: DataFrame, axes: list[str], key: str = "cluster") -> DataFrame:
    """Share and min-max scaled axes of a small summary table (one row per segment)."""
    whole = Window.partitionBy()
    share = F.when(F.sum("count").over(whole) > 0, F.floor(F.col("count") / F.sum("count").over(whole) * 100 + 0.5))
    out = df.withColumn("share_pct", F.coalesce(share, F.lit(0)).cast("bigint"))
    for axis in axes:
        x = F.coalesce(F.col(axis).cast("double"), F.lit(0.0))
        low, high = F.min(x).over(whole), F.max(x).over(whole)
        scaled = F.when(low == high, F.lit(0.5)).otherwise((x - low) / (high - low))
        out = out.withColumn(f"{axis}_axis", F.when(high > 0, scaled))
    return out.select(key, "share_pct", *[f"{axis}_axis" for axis in axes])
