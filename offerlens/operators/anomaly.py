"""Price anomalies: quartile fences, log z-score, per-segment fences, lists and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.features import shorten
from ..functions.numeric import half_even
from .dedup import dedup_display
from .distribution import attach, quantiles

FLAGS = {
    "iqr": "anomaly_iqr", "zscore": "anomaly_zscore", "iforest": "anomaly_iforest", "lof": "anomaly_lof",
    "contextual": "anomaly_contextual",
}
METHOD_NAMES = {
    "IQR": "anomaly_iqr", "Z-score": "anomaly_zscore", "Isolation Forest": "anomaly_iforest", "LOF": "anomaly_lof",
    "Contextuel": "anomaly_contextual",
}


def _side(price: Column, low: Column, high: Column) -> Column:
    return F.when(low, F.lit("trop_bas")).when(high, F.lit("trop_haut")).otherwise(F.lit("normal"))


def _outside(price: Column, low: Column, high: Column) -> Column:
    """True outside the closed interval; a missing price is outside."""
    return F.coalesce((price < low) | (price > high), F.lit(True))


def detect_iqr(df: DataFrame, factor: float = 2.5) -> DataFrame:
    """Flag prices beyond the quartiles by ``factor`` interquartile ranges."""
    marks = quantiles(df, [], "price", {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    fence = marks.select((F.col("q1") - factor * spread).alias("low"), (F.col("q3") + factor * spread).alias("high"))
    price, low, high = F.col("price"), F.col("_q.low"), F.col("_q.high")
    return attach(df, fence).withColumns({
        "anomaly_iqr": _outside(price, low, high),
        "anomaly_iqr_type": _side(price, price < low, price > high),
    }).drop("_q")


def detect_zscore(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Flag |z| of log1p(price) above the threshold (population deviation)."""
    log = F.log1p("price")
    moments = df.agg(F.avg(log).alias("m"), F.stddev_pop(log).alias("s"))
    both = attach(moments, quantiles(df, [], "price", {"median": 0.5})).select("m", "s", "_q.median")
    median = F.col("_q.median")
    out = attach(df, both).withColumn("_z", F.abs(F.try_divide(log - F.col("_q.m"), F.col("_q.s"))))
    flag = F.coalesce(F.col("_z") > threshold, F.lit(False))
    price = F.col("price")
    return out.withColumns({
        "anomaly_zscore": flag,
        "zscore_value": half_even(F.col("_z"), 4),
        "anomaly_zscore_type": _side(price, flag & (price < median), flag & (price > median)),
    }).drop("_z", "_q")


def detect_contextual(df: DataFrame, factor: float = 2.0, at_least: int = 10) -> DataFrame:
    """Flag prices that are far off in their segment; segments below ``at_least`` rows flag nothing.

    Without segments the whole table is one, with factor 2.5. The table of
    fences has one row per segment name and is joined as a map.
    """
    price = F.col("price")
    if "cluster" not in df.columns:
        plain = detect_iqr(df, 2.5)
        return plain.withColumnRenamed("anomaly_iqr", "anomaly_contextual").drop("anomaly_iqr_type")
    fences = quantiles(df, ["cluster"], "price", {"q1": 0.25, "q3": 0.75})
    sizes = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
    spread = F.col("q3") - F.col("q1")
    entries = fences.join(sizes, "cluster").where(F.col("rows") >= at_least).select(
        F.struct("cluster", F.struct(
            (F.col("q1") - factor * spread).alias("low"), (F.col("q3") + factor * spread).alias("high")
        )).alias("e")
    )
    table = entries.agg(F.map_from_entries(F.collect_list("e"))).scalar()
    df = df.withColumn("_t", table).withColumn("_f", F.try_element_at("_t", F.col("cluster")))
    fence = F.col("_f")
    flag = F.when(fence.isNull(), F.lit(False)).otherwise(
        _outside(price, fence.getField("low"), fence.getField("high"))
    )
    return df.withColumn("anomaly_contextual", F.coalesce(flag, F.lit(False))).drop("_t", "_f")


def anomaly_summary(df: DataFrame) -> DataFrame:
    """Count and share of every flag that is present, in one aggregate."""
    rows = F.count(F.lit(1))
    parts = [
        F.struct(
            F.lit(name).alias("methode"), F.count_if(F.col(flag)).alias("anomalies"),
            half_even(F.count_if(F.col(flag)) / rows * 100, 2).alias("pourcentage"),
        )
        for name, flag in METHOD_NAMES.items() if flag in df.columns
    ]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def anomalies(df: DataFrame, method: str = "iforest", worst_first: bool = False) -> DataFrame:
    """Flagged rows, by score if the method has one, else by price.

    Scores sort upwards; for the density method a higher score is worse, so
    ``worst_first`` turns its order round.
    """
    flag = FLAGS.get(method, FLAGS["iforest"])
    if flag not in df.columns:
        raise ValueError(f"no column {flag}: run the detector first")
    score = f"{flag}_score"
    found = df.where(F.col(flag))
    if score not in df.columns:
        return found.orderBy("price")
    return found.orderBy(F.desc(score) if worst_first and method == "lof" else F.asc(score))


def anomaly_list(df: DataFrame, flag: str, order: list[str], category: str | None = None, descending: bool = False) -> DataFrame:
    """Flagged rows, one per (first 60 title characters, price), of one price category or of all, by price."""
    found = dedup_display(df.where(F.col(flag)), order)
    if category is not None:
        found = found.where(F.col("price_category") == category)
    return found.orderBy(F.desc("price") if descending else F.asc("price"), *order)


def chart_anomalies(df: DataFrame, method: str = "iforest", top: int = 100) -> DataFrame:
    """Cheapest flagged rows for a chart; an unknown method means the isolation forest."""
    flag = {m: FLAGS[m] for m in ("iqr", "zscore", "iforest")}.get(method, FLAGS["iforest"])
    names = ["title", "price"] + (["brand_detected"] if "brand_detected" in df.columns else [])
    return df.where(F.col(flag)).select(*names).orderBy("price", *[c for c in names if c != "price"]).limit(top)


def explained_anomalies(df: DataFrame, method: str = "iforest", top: int | None = 100) -> DataFrame:
    """Flagged rows with the median of their segment and the reason.

    The per-segment medians are one row per segment name and travel as a map;
    rows without a segment compare with the global median.
    """
    flag = {m: FLAGS[m] for m in ("iqr", "zscore", "iforest", "lof")}.get(method, FLAGS["iforest"])
    price = F.col("price")
    found = attach(df.where(F.col(flag)), quantiles(df, [], "price", {"median": 0.5}))
    median, cluster = F.col("_q.median"), F.lit("")
    if "cluster" in df.columns:
        cluster = F.coalesce("cluster", F.lit(""))
        entries = quantiles(df, ["cluster"], "price", {"median": 0.5}).agg(
            F.map_from_entries(F.collect_list(F.struct("cluster", "median")))
        )
        found = found.withColumn("_t", entries.scalar())
        median = F.when(cluster == "", median).otherwise(F.try_element_at("_t", cluster))
    found = found.withColumn("_m", median)
    ratio = F.when(F.col("_m") > 0, price / F.col("_m")).otherwise(F.lit(1.0))
    found = found.withColumn("_r", ratio)
    r = F.col("_r")

    def percent(x: Column) -> Column:
        return F.rint(x * 100).cast("bigint").cast("string")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")

    kind = F.when(r < 0.5, F.lit("trop_bas")).when(r > 2.0, F.lit("trop_haut")).otherwise(F.lit("suspect"))
    reason = (
        F.when(r < 0.5, F.concat(F.lit("Prix "), percent(1 - r), F.lit("% sous la médiane du cluster")))
        .when(r > 2.0, F.concat(F.lit("Prix "), percent(r - 1), F.lit("% au-dessus de la médiane du cluster")))
        .otherwise(F.lit("Combinaison prix/specs inhabituelle"))
    )
    columns = [
        shorten(F.col("title"), 80).alias("title"), half_even(price, 2).alias("price"),
        text("brand_detected").alias("brand_detected"), text("price_category").alias("price_category"),
        cluster.alias("cluster"), half_even(F.col("_m"), 2).alias("cluster_median"), kind.alias("anomaly_type"),
        reason.alias("reason"), text("source").alias("source"),
    ]
    score = f"{flag}_score"
    if score in df.columns:
        columns.append(half_even(F.col(score), 4).alias("score"))
    out = found.select(*columns)
    lead = "score" if score in df.columns else "price"
    out = out.orderBy(lead, *[c for c in out.columns if c != lead])
    return out if top is None else out.limit(top)
