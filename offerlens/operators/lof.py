"""Local outlier factor with exact nearest neighbours of distinct vectors, by cells of a k-d tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import free_finished, shared_folder, stored
from .neighbours import nearest_rows, placed_vectors
from .vectors import distinct_vectors, feature_names, flag_scores, with_vectors


def local_outlier_factors(near: DataFrame) -> DataFrame:
    """(id, lof) from (id, other, copies, dist) of the k nearest rows of every vector."""
    reach = near.groupBy("id").agg(F.max("dist").alias("kd"))
    copies = F.sum("copies")
    with_reach = near.join(reach.withColumnRenamed("id", "other"), "other")
    mean_reach = F.sum(F.col("copies") * F.greatest("kd", "dist")) / copies
    density = stored(with_reach.groupBy("id").agg((1.0 / (mean_reach + 1e-10)).alias("lrd")), "lof-density")
    with_density = near.join(density.select(F.col("id").alias("other"), "lrd"), "other")
    around = with_density.groupBy("id").agg((F.sum(F.col("copies") * F.col("lrd")) / copies).alias("around"))
    return around.join(density, "id").select("id", (F.col("around") / F.col("lrd")).alias("lof"))


def detect_lof(
    df: DataFrame, features: list[str] | None = None, n_neighbors: int = 20, contamination: float = 0.05
) -> DataFrame:
    """Flag rows in sparser surroundings than their neighbours; the score is higher for worse rows.

    With fewer than two rows nothing is flagged and the score is 1.
    """
    points, names = with_vectors(df, feature_names(df, features))
    vectors = distinct_vectors(points, names)
    rows = vectors.agg(F.sum("c")).first()[0] or 0
    if rows < 2:
        return df.withColumn("anomaly_lof", F.lit(False)).withColumn("anomaly_lof_score", F.lit(1.0))
    k = min(max(5, min(n_neighbors, rows // 10)), rows - 1)
    placed = placed_vectors(vectors, names)
    path = shared_folder(df.sparkSession, "lof-near")
    factors = local_outlier_factors(nearest_rows(placed, names, k, path))
    scores = stored(placed.join(factors, "id").select(*names, "c", (-F.col("lof")).alias("s")), "lof-scores")
    free_finished(df.sparkSession, path)
    return flag_scores(points, names, scores, "lof", contamination, -1.0)
