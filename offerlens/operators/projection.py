"""Two-dimensional principal components of the feature columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.features import shorten
from ..functions.numeric import half_even
from .scaling import imputed
from .vectors import ANOMALY_FEATURES


def principal_axes(df: DataFrame, columns: list[str], count: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Means and leading axes from one aggregate row of a fixed few numbers.

    The largest loading of an axis is positive.
    """
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    covs = [
        F.covar_samp(a, b).alias(f"s{i}_{j}")
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j
    ]
    row = df.agg(*means, *covs).first()
    size = len(columns)
    center = np.array([row[f"m{i}"] or 0.0 for i in range(size)])
    cov = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)])
    _, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :count].T
    signs = [np.sign(a[np.argmax(np.abs(a))]) or 1.0 for a in axes]
    return center, axes * np.array(signs)[:, None]


def pca_scatter(df: DataFrame) -> DataFrame:
    """Offers on the first two components of the centred, unscaled features."""
    columns = [c for c in ANOMALY_FEATURES if c in df.columns]
    if "cluster" not in df.columns or len(columns) < 2:
        return df.sparkSession.createDataFrame(
            [], "x double, y double, cluster string, title string, price double, brand string"
        )
    copies = {f"_p{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    ready = imputed(df.withColumns(copies), list(copies))
    center, axes = principal_axes(ready, list(copies))

    def along(axis: np.ndarray):
        terms = [(F.col(n) - float(m)) * float(w) for n, m, w in zip(copies, center, axis)]
        return half_even(sum(terms[1:], terms[0]), 4)

    return ready.select(
        along(axes[0]).alias("x"), along(axes[1]).alias("y"), F.coalesce("cluster", F.lit("")).alias("cluster"),
        shorten(F.coalesce("title", F.lit("")), 50).alias("title"), F.col("price").cast("double").alias("price"),
        F.coalesce("brand_detected", F.lit("")).alias("brand"),
    )
