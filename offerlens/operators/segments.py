"""Price segments: fixed bands, k-means, their quality and their summaries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..dims import BAND_EPS, BAND_MIN_SAMPLES, PRICE_BANDS, SEGMENT_NAMES
from ..functions.features import shorten
from ..functions.numeric import half_even
from ..session import materialize, stored
from .cluster_quality import vector_quality
from .distribution import quantiles, running_counts, value_counts
from .scaling import fixed_scaled, usable_features
from .stats import group_stats

KMEANS_FEATURES = ["log_price"]


def price_bands(df: DataFrame) -> DataFrame:
    """Segments by fixed price bands; prices outside all bands are Premium."""
    price, last = F.col("price"), len(PRICE_BANDS) - 1
    ids = F
    for i, (a, z, _) in enumerate(PRICE_BANDS):
        ids = ids.when((price >= a) & (price < z), F.lit(i))
    ids = ids.otherwise(F.lit(last))
    names = F.array(*[F.lit(n) for n in SEGMENT_NAMES])
    return df.withColumn("cluster_id", ids).withColumn("cluster", F.get(names, F.col("cluster_id")))


def kmeans_points(df: DataFrame, features: list[str]) -> DataFrame:
    """Imputed, robust-scaled features as x0, x1, ... beside the input columns."""
    known = {
        f"v{i}": F.nullif(F.col(c), F.lit(0)) if c == "cpu_score" else F.col(c) for i, c in enumerate(features)
    }
    return fixed_scaled(df, known, [f"x{i}" for i in range(len(features))])


def collapsed(points: DataFrame, width: int) -> DataFrame:
    """Distinct points with their row counts, materialised once for all fits."""
    names = [f"x{i}" for i in range(width)]
    counts = points.groupBy(*names).agg(F.count(F.lit(1)).alias("c"))
    vector = VectorAssembler(inputCols=names, outputCol="features")
    return materialize(vector.transform(counts.withColumn("weight", F.col("c").cast("double"))))


def best_kmeans_each(points: DataFrame, ks: list[int], restarts: int = 10, seed: int = 42) -> dict[int, KMeansModel]:
    """Per k the model with the lowest cost of several seeded fits on weighted distinct points.

    The fits do not depend on each other, so their jobs run side by side.
    """
    def fit(task: tuple[int, int]) -> KMeansModel:
        k, i = task
        means = KMeans(k=k, seed=seed + i, weightCol="weight", featuresCol="features", predictionCol="cluster_id")
        return means.fit(points)

    tasks = [(k, i) for k in ks for i in range(restarts)]
    with ThreadPoolExecutor(max_workers=min(8, len(tasks))) as pool:
        models = list(pool.map(inheritable_thread_target(points.sparkSession)(fit), tasks))
    return {k: min(models[i * restarts:(i + 1) * restarts], key=lambda m: m.summary.trainingCost) for i, k in enumerate(ks)}


def best_kmeans(points: DataFrame, k: int, restarts: int = 10, seed: int = 42) -> KMeansModel:
    """Model with the lowest cost of several seeded fits on weighted distinct points."""
    return best_kmeans_each(points, [k], restarts, seed)[k]


def name_clusters(df: DataFrame) -> DataFrame:
    """Add ``cluster``: names by rising median price; id -1 is noise.

    One row per cluster comes to the driver.
    """
    medians = quantiles(df.where(F.col("cluster_id") != -1), ["cluster_id"], "price", {"median": 0.5})
    place = F.row_number().over(Window.partitionBy().orderBy("median", "cluster_id"))
    names = F.array(*[F.lit(n) for n in SEGMENT_NAMES])
    name = F.coalesce(F.get(names, place - 1), F.concat(F.lit("Cluster "), place.cast("string")))
    pairs = [F.lit(x) for row in medians.select("cluster_id", name.alias("name")).collect() for x in row]
    noise = F.when(F.col("cluster_id") == -1, F.lit("Bruit/Outlier"))
    if not pairs:
        return df.withColumn("cluster", noise)
    return df.withColumn("cluster", noise.otherwise(F.try_element_at(F.create_map(*pairs), F.col("cluster_id"))))


def nearest_center(centers: list, columns: list[str]) -> Column:
    """Index of the nearest of a few centres, as a built-in expression."""
    def squared(center) -> Column:
        return sum(((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(columns, center)), F.lit(0.0))

    distances = F.array(*[squared(c) for c in centers])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def kmeans_segments(
    df: DataFrame, k: int = 5, features: list[str] | None = None, restarts: int = 10, seed: int = 42
) -> DataFrame:
    """K-means segments with ``cluster_id`` and ``cluster`` columns."""
    features = features or usable_features(df, KMEANS_FEATURES)
    if not features:
        raise ValueError("no feature for k-means")
    points = kmeans_points(df, features)
    distinct = collapsed(points, len(features))
    rows = distinct.agg(F.sum("c")).first()[0] or 0
    if rows < k:
        raise ValueError(f"{rows} offers are too few for {k} clusters")
    model = best_kmeans(distinct, k, restarts, seed)
    names = [f"x{i}" for i in range(len(features))]
    placed = points.withColumn("cluster_id", nearest_center(model.clusterCenters(), names))
    return name_clusters(placed.select(*df.columns, "cluster_id"))


def _cluster_moments(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, "cluster_id").agg(
        F.sum("c").alias("size"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")
    )


def silhouettes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact mean silhouette per key of weighted one-dimensional clusters that are intervals.

    ``counts`` holds (keys, cluster_id, v, c). Within a cluster the sum of
    distances follows from running counts and sums; to another interval the
    mean distance is the distance to its mean. Single-row clusters score 0.
    """
    inner = running_counts(counts.withColumn("v", F.col("v").cast("double")), [*keys, "cluster_id"], sums=True)
    v, c, n = F.col("v"), F.col("c"), F.col("n")
    below, sum_below = F.col("before"), F.col("sum_before")
    above = n - below - c
    sum_above = F.col("sum_n") - sum_below - v * c
    own = (v * below - sum_below + sum_above - v * above) / (n - 1)
    moments = _cluster_moments(counts, keys)
    # a key has few clusters: their means travel as one array per key
    means = moments.groupBy(*keys).agg(F.collect_list(F.struct("cluster_id", "mean")).alias("means"))
    if keys:
        joined = inner.join(means, keys)
    else:
        joined = inner.withColumn("means", means.scalar())  # one array of a row per cluster
    others = F.filter("means", lambda m: m["cluster_id"] != F.col("cluster_id"))
    near = F.array_min(F.transform(others, lambda m: F.abs(m["mean"] - v)))
    score = F.when((n > 1) & (F.greatest(own, near) > 0), (near - own) / F.greatest(own, near)).otherwise(F.lit(0.0))
    return joined.groupBy(*keys).agg((F.sum(score * c) / F.sum(c)).alias("silhouette"))


def davies_bouldin(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Davies-Bouldin index per key of weighted one-dimensional clusters."""
    moments = _cluster_moments(counts, keys)
    spread = (
        counts.join(moments, [*keys, "cluster_id"]).groupBy(*keys, "cluster_id", "mean")
        .agg((F.sum(F.abs(F.col("v") - F.col("mean")) * F.col("c")) / F.sum("c")).alias("s"))
    )
    table = spread.groupBy(*keys).agg(F.collect_list(F.struct("cluster_id", "mean", "s")).alias("t"))
    worst = F.transform("t", lambda a: F.array_max(F.transform(
        F.filter("t", lambda b: b["cluster_id"] != a["cluster_id"]),
        lambda b: F.try_divide(a["s"] + b["s"], F.abs(a["mean"] - b["mean"])),
    )))
    total = F.aggregate(worst, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return table.select(*keys, (total / F.size("t")).alias("davies_bouldin"))


def cluster_counts(df: DataFrame, value: str) -> DataFrame:
    """(cluster_id, v, c) of assigned rows."""
    return df.groupBy("cluster_id", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def band_quality(df: DataFrame) -> DataFrame:
    """One row for the band segments: constants, number of bands used and silhouette of log_price."""
    counts = cluster_counts(df, "log_price")
    used = counts.agg(F.count_distinct("cluster_id").alias("n_clusters"))
    sil = silhouettes(counts, []).scalar()
    return used.select(
        F.lit(BAND_EPS).alias("eps"), F.lit(BAND_MIN_SAMPLES).alias("min_samples"), "n_clusters",
        F.lit(0).alias("n_outliers"),
        half_even(F.when(F.col("n_clusters") > 1, sil).otherwise(F.lit(0.0)), 4).alias("silhouette"),
    )


def score_k(
    df: DataFrame, ks: range = range(2, 8), restarts: int = 10, seed: int = 42, features: list[str] | None = None
) -> DataFrame:
    """Per k below the number of rows: inertia, silhouette, Davies-Bouldin and smallest cluster.

    ``features``: columns to cluster by, log_price by default. Fits run on distinct vectors with weights; all k are judged together, from sorted
    values for one feature, else from exact distances of distinct vectors.
    """
    features = features or KMEANS_FEATURES
    names = [f"x{i}" for i in range(len(features))]
    points = collapsed(kmeans_points(df, features), len(features))
    rows = points.agg(F.sum("c")).first()[0] or 0
    spark = df.sparkSession
    models = best_kmeans_each(points, [k for k in ks if k < rows], restarts, seed) if any(k < rows for k in ks) else {}
    if not models:
        return spark.createDataFrame([], "k int, inertia double, silhouette double, davies_bouldin double, rows bigint, smallest bigint")
    costs = [(k, float(m.summary.trainingCost)) for k, m in models.items()]
    inertia = spark.createDataFrame(costs, "k int, inertia double")
    if len(features) > 1:
        labels = {f"k{k}": nearest_center(m.clusterCenters(), names) for k, m in models.items()}
        placed = points.select(*names, "c", *[label.alias(name) for name, label in labels.items()])
        judged = vector_quality(placed, names, list(labels), weight="c")
        judged = judged.withColumn("k", F.substring("labelling", 2, 9).cast("int")).drop("labelling", "clusters")
        return inertia.join(judged, "k").select(
            "k", half_even(F.col("inertia"), 2).alias("inertia"), "silhouette", "davies_bouldin", "rows", "smallest").orderBy("k")
    counts = None
    for k, model in models.items():
        placed = points.select(F.lit(k).alias("k"), nearest_center(model.clusterCenters(), names).alias("cluster_id"), F.col("x0").alias("v"), "c")
        counts = placed if counts is None else counts.union(placed)
    counts = stored(counts, "k-counts")  # the three measures read them six times
    sizes = _cluster_moments(counts, ["k"]).groupBy("k").agg(
        F.sum("size").alias("rows"), F.min("size").alias("smallest")
    )
    return (
        inertia.join(silhouettes(counts, ["k"]), "k").join(davies_bouldin(counts, ["k"]), "k").join(sizes, "k")
        .select("k", half_even(F.col("inertia"), 2).alias("inertia"),
                half_even(F.col("silhouette"), 4).alias("silhouette"),
                half_even(F.col("davies_bouldin"), 4).alias("davies_bouldin"), "rows", "smallest")
        .orderBy("k")
    )


def choose_k(scores: DataFrame, fallback: int = 5, size_rule: bool = True) -> int:
    """k with the best silhouette among those without a tiny cluster (reads one row)."""
    fit = scores
    if size_rule:
        fit = scores.where(F.col("smallest") >= F.greatest(F.lit(10.0), F.col("rows") * 0.01))
    best = fit.orderBy(F.desc("silhouette"), "k").select("k").first()
    return best["k"] if best else fallback


def neighbour_eps(df: DataFrame, min_samples: int = 5, percentile: float = 50.0, lowest: float = 0.05) -> float:
    """Distance to the min_samples-th neighbour (self included) of scaled log_price, at a percentile.

    Exact over all rows: copies of a value count, so the neighbour is found
    among the nearest distinct values and their running counts.
    """
    counts = value_counts(kmeans_points(df, ["log_price"]), [], "x0")
    # nearest distinct values: at most min_samples-1 on either side can matter
    reach = min_samples - 1
    numbered = number_values(counts)
    base = numbered.select(F.col("v"), F.col("c"), F.col("i"))
    near = numbered.select(F.col("v").alias("w"), F.col("c").alias("m"), F.col("i").alias("j"))
    pairs = base.select("v", "c", F.explode(F.sequence(F.col("i") - reach, F.col("i") + reach)).alias("j")).join(near, "j")
    order = Window.partitionBy("v").orderBy(F.abs(F.col("v") - F.col("w")))
    reached = pairs.withColumn("got", F.sum("m").over(order)).where(F.col("got") >= min_samples)
    nearest = reached.groupBy("v").agg(F.min(F.abs(F.col("v") - F.col("w"))).alias("x"), F.max("c").alias("c"))
    row = quantiles(nearest, [], "x", {"eps": percentile / 100}, weight="c").first()
    return max(row["eps"] or 0.0, lowest)


def number_values(counts: DataFrame) -> DataFrame:
    """Add ``i``: 0-based place of each distinct value, without one global sort."""
    ones = counts.select("v", F.lit(1).alias("c"))
    return running_counts(ones, []).select("v", F.col("before").alias("i")).join(counts, "v")


def most_frequent(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Most frequent value per key; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(name))


def cluster_summary(df: DataFrame) -> DataFrame:
    """Per segment: prices, most frequent brand, gaming share, mean processor score and memory."""
    rows = group_stats(df, ["cluster"], ["count", "mean", "min", "max", "std"], {"median": 0.5})
    names = ["cluster", "count", "mean", "median", "min", "max", "std"]
    extra: list[Column] = []
    if "is_gaming" in df.columns:
        extra.append(half_even(F.avg(F.col("is_gaming").cast("double")) * 100, 1).alias("gaming_pct"))
    if "cpu_score" in df.columns:
        extra.append(half_even(F.avg("cpu_score"), 1).alias("avg_cpu_score"))
    if "ram_gb" in df.columns:
        extra.append(half_even(F.avg("ram_gb"), 1).alias("avg_ram_gb"))
    out = rows.select(*names)
    if "brand_detected" in df.columns:
        out = out.join(most_frequent(df, "cluster", "brand_detected", "top_brand"), "cluster", "left")
    if extra:
        out = out.join(df.groupBy("cluster").agg(*extra), "cluster")
    return out


def cluster_table(df: DataFrame) -> DataFrame:
    """Per segment: count, mean, median, min and max."""
    rows = group_stats(df, ["cluster"], ["count", "mean", "min", "max"], {"median": 0.5})
    return rows.select("cluster", "count", "mean", "median", "min", "max")


def scatter_row(df: DataFrame) -> DataFrame:
    """Columns of a scatter plot."""
    return df.select(
        shorten(F.col("title"), 60).alias("title"), F.col("price").cast("double").alias("price"), "cluster",
        F.col("brand_detected").alias("brand"), F.col("is_gaming").alias("gaming"),
    )
