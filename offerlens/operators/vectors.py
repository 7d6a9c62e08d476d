"""Feature vectors of offers: imputed, scaled and collapsed to distinct vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import half_even
from ..session import materialize
from .distribution import attach, quantiles
from .scaling import fixed_scaled

ANOMALY_FEATURES = ["log_price", "ram_gb", "storage_gb", "cpu_score"]


def feature_names(df: DataFrame, features: list[str] | None = None) -> list[str]:
    return features or [c for c in ANOMALY_FEATURES if c in df.columns] or ["price"]


def with_vectors(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Add imputed robust-scaled features as f0, f1, ..."""
    names = [f"f{i}" for i in range(len(features))]
    return fixed_scaled(df, {f"v{i}": F.col(c) for i, c in enumerate(features)}, names), names


def distinct_vectors(points: DataFrame, names: list[str]) -> DataFrame:
    """Distinct vectors with their row count ``c``, written once."""
    return materialize(points.groupBy(*names).agg(F.count(F.lit(1)).alias("c")))


def flag_scores(
    points: DataFrame, names: list[str], scores: DataFrame, method: str, contamination: float, sign: float
) -> DataFrame:
    """Attach vector scores to rows and flag the rows below the contamination percentile.

    ``scores`` has one row per vector with ``c`` and ``s`` (lower is worse);
    the stored score is ``sign`` times s. Hot vectors sit on the row side of
    the join, where adaptive execution splits them.
    """
    cut = quantiles(scores, [], "s", {"cut": contamination}, weight="c")
    judged = attach(scores, cut).select(
        *names, (F.col("s") < F.col("_q.cut")).alias(f"anomaly_{method}"),
        half_even(F.col("s") * sign, 4).alias(f"anomaly_{method}_score"),
    )
    kept = [c for c in points.columns if c not in names]
    return points.join(judged, names).select(*kept, f"anomaly_{method}", f"anomaly_{method}_score")
