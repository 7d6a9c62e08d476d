"""The whole market report: every result as a DataFrame, and all of them as one nested JSON document."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import anomaly, distribution, iforest, lof, projection, rules, sampling, segments, stats
from ..operators.clean import clean_offers, load_bounds, nulls_for_json, prepare_accessories
from ..operators.enrich import add_features
from ..operators.scaling import scaled
from ..session import ensure_checkpoint_dir, materialize

SCATTER_ROWS = 300
SCATTER_ID = ["link", "title", "price", "source"]


def prepare(offers: DataFrame) -> DataFrame:
    """Load bounds, cleaning, features and scaled prices; the features are written once, so that the scales do not read the offers again."""
    return scaled(materialize(add_features(clean_offers(load_bounds(offers)))), ["price", "log_price"])


def side_by_side(spark: SparkSession, *branches: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Results of branches that do not read each other; their small jobs overlap."""
    with ThreadPoolExecutor(max_workers=len(branches)) as pool:
        found = pool.map(lambda run: run(), [inheritable_thread_target(spark)(b) for b in branches])
        return {name: df for results in found for name, df in results.items()}


def market_report(
    offers: DataFrame, accessories: DataFrame, k: int | None = None, restarts: int = 10, cut_lineage: bool = True,
) -> dict[str, DataFrame]:
    """All results by name.

    The feature table and the scored table are written once (checkpoint) since
    many results read them; every result itself stays lazy. What does not build
    on each other is prepared side by side.
    """
    spark = offers.sparkSession
    ensure_checkpoint_dir(spark)
    keep = materialize if cut_lineage else (lambda df: df)
    parts: dict[str, DataFrame] = {}

    def statistics() -> dict[str, DataFrame]:
        df = parts["offers"]
        return {
            "stats": stats.descriptive_stats(df), "stats_by_brand": stats.stats_by_brand(df),
            "stats_by_category": stats.stats_by_category(df), "gaming_stats": stats.gaming_groups(df),
            "gaming_test": stats.mann_whitney(df), "percentiles": stats.price_percentiles(df),
            "histogram": distribution.plain_histogram(df), "brand_bar": stats.brand_bar(df),
            "boxplot_by_source": stats.boxplot_by_source(df),
        }

    def clusters() -> dict[str, DataFrame]:
        df = parts["offers"]
        scores = materialize(segments.score_k(df, restarts=restarts))
        chosen = k or max(segments.choose_k(scores), 5)
        parts["clustered"] = keep(segments.kmeans_segments(df, chosen, restarts=restarts))
        return {"k_scores": scores, "best_k": spark.range(1).select(F.lit(chosen).alias("best_k"))}

    def bands() -> dict[str, DataFrame]:
        banded = segments.price_bands(parts["offers"])
        return {"dbscan_summary": segments.cluster_summary(banded), "dbscan_attrs": segments.band_quality(banded)}

    def summaries() -> dict[str, DataFrame]:
        clustered = parts["clustered"]
        return {
            "kmeans_summary": segments.cluster_summary(clustered),
            "cluster_scatter": segments.scatter_row(sampling.hash_sample(clustered, SCATTER_ROWS, SCATTER_ID)),
            "pca_scatter": sampling.hash_sample(projection.pca_scatter(clustered), SCATTER_ROWS, ["title", "price", "x", "y"]),
            "radar_clusters": stats.radar(segments.cluster_table(clustered), ["median", "count", "mean"]),
        }

    def anomalies() -> dict[str, DataFrame]:
        flagged = anomaly.detect_zscore(anomaly.detect_iqr(parts["clustered"]))
        flagged = keep(anomaly.detect_contextual(lof.detect_lof(iforest.detect_isolation_forest(flagged))))
        parts["flagged"] = flagged
        return {
            "anomaly_summary": anomaly.anomaly_summary(flagged), "anomalies": anomaly.explained_anomalies(flagged, "iforest", 150),
            "association_rules": rules.laptop_rules(flagged),
        }

    def accessory_results() -> dict[str, DataFrame]:
        parts["accessories"] = keep(prepare_accessories(accessories))
        return {"accessory_stats": stats.accessory_stats(parts["accessories"]), "accessory_rules": rules.accessory_rules(parts["accessories"])}

    def laptop_results() -> dict[str, DataFrame]:
        parts["offers"] = keep(prepare(offers))
        return side_by_side(spark, statistics, bands, lambda: {**clusters(), **side_by_side(spark, summaries, anomalies)})

    out = side_by_side(spark, laptop_results, accessory_results)
    out["cross_rules"] = rules.cross_rules(parts["flagged"], parts["accessories"])
    return out


#: Sections of the document: name in the document -> (result, columns that its rows stand in order of, - for falling). No columns: one object.
PAYLOAD = {
    "laptops": {
        "stats": ("stats", []), "best_k": ("best_k", []), "k_scores": ("k_scores", ["k"]),
        "kmeans_summary": ("kmeans_summary", ["mean"]), "dbscan_summary": ("dbscan_summary", ["mean"]), "dbscan_attrs": ("dbscan_attrs", []),
        "histogram": ("histogram", ["bin"]), "boxplot_by_source": ("boxplot_by_source", ["source"]),
        "cluster_scatter": ("cluster_scatter", ["price", "title"]), "pca_scatter": ("pca_scatter", ["price", "title"]),
        "brand_bar": ("brand_bar", ["-count", "brand_detected"]), "radar_clusters": ("radar_clusters", ["median_axis", "cluster"]),
        "anomalies": ("anomalies", ["score", "price", "title"]), "anomaly_summary": ("anomaly_summary", ["method"]),
        "association_rules": ("association_rules", ["-lift", "antecedent", "consequent"]),
    },
    "accessories": {
        "stats_by_category": ("accessory_stats", ["category"]), "boxplot_categories": ("accessory_stats", ["category"]),
        "association_rules": ("accessory_rules", ["-lift", "antecedent", "consequent"]),
    },
    "cross_association": {"rules": ("cross_rules", ["-lift", "antecedent", "consequent"])},
}


def _value(df: DataFrame, order: list[str]) -> Column:
    """A bounded result as one value: an array of its rows in order, or its only row."""
    clean = nulls_for_json(df)
    if not order:
        return clean.limit(1).select(F.struct("*")).scalar()
    keys = [-F.col(c[1:]).cast("double") if c.startswith("-") else F.col(c) for c in order if c.removeprefix("-") in df.columns]
    placed = F.struct(F.struct(*keys, *df.columns).alias("place"), F.struct(*df.columns).alias("row")) if keys else F.struct(F.struct(*df.columns).alias("row"))
    return clean.agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["row"])).scalar()


def payload(results: dict[str, DataFrame]) -> DataFrame:
    """One row with the whole document as JSON, assembled in one plan; NaN and infinities are null.

    Every result is bounded: summaries, top lists, samples of points.
    """
    spark = results["stats"].sparkSession
    sections = []
    for section, names in PAYLOAD.items():
        values = [_value(results[source], order).alias(name) for name, (source, order) in names.items()]
        sections.append((values[0] if section == "cross_association" else F.struct(*values)).alias(section))
    text = F.to_json(F.struct(*sections), {"ignoreNullFields": "false"})
    return spark.range(1).select(text.alias("payload"))


def payload_keys(document: DataFrame) -> DataFrame:
    """(section, name, json) of every key of the document."""
    rows = []
    for section, names in PAYLOAD.items():
        for name in names:
            path = "$.cross_association" if section == "cross_association" else f"$.{section}.{name}"
            rows.append(F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.get_json_object("payload", path).alias("json")))
    return document.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def write_payload(results: dict[str, DataFrame], folder: str) -> None:
    """The document as one line of text; it is bounded, so one file."""
    payload(results).coalesce(1).write.mode("overwrite").text(folder)


def save_report(spark: SparkSession, results: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per result."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
