"""Isolation forest: trees grow on bounded hash samples, vectors are scored in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .vectors import distinct_vectors, feature_names, flag_scores, with_vectors

TREE_SCHEMA = "tree int, node int, feature int, cut double, length double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(sample: np.ndarray, depth_limit: int, rng: np.random.Generator) -> list[tuple[int, int, float, float]]:
    """Nodes (heap place, feature or -1, cut, path length at a leaf) of one random tree."""
    nodes, todo = [], [(0, sample, 0)]
    while todo:
        place, rows, depth = todo.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        open_features = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or len(open_features) == 0:
            nodes.append((place, -1, 0.0, depth + average_path(len(rows))))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        left = rows[:, f] <= cut
        nodes.append((place, f, cut, 0.0))
        todo.append((2 * place + 1, rows[left], depth + 1))
        todo.append((2 * place + 2, rows[~left], depth + 1))
    return nodes


def forest_samples(
    points: DataFrame, names: list[str], rows: int, trees: int, size: int, seed: int
) -> DataFrame:
    """``size`` rows for every tree, drawn without replacement in hash order.

    A first hash filter leaves about 1.3 * trees * size rows of a large table,
    so what is spread over the trees does not grow with the data.
    """
    pool_size = min(float(rows), 1.3 * trees * size)
    identity = [c for c in points.columns if c not in names]
    unit = 2.0**63
    pick = F.abs(F.xxhash64(*identity, *names, F.lit(seed))) / F.lit(unit)
    pool = points.where(pick < pool_size / rows).select(*names, F.xxhash64(*identity, *names).alias("_r"))
    # the pool is bounded, so spreading it over all cores is cheap
    pool = pool.repartition(points.sparkSession.sparkContext.defaultParallelism)
    spread = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    spread = spread.withColumn("_u", F.abs(F.xxhash64("_r", "tree", F.lit(seed + 1))) / F.lit(unit))
    likely = spread.where(F.col("_u") < min(1.0, 3.0 * size / pool_size + 0.01))
    order = Window.partitionBy("tree").orderBy("_u", "_r", *names)
    return likely.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).select("tree", *names)


def fit_forest(samples: DataFrame, names: list[str], size: int, seed: int) -> DataFrame:
    """Tree nodes of all trees; a group holds at most ``size`` sampled rows."""
    depth_limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(names)[names].to_numpy(dtype=float)
        nodes = grow(rows, depth_limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "length"])
        out.insert(0, "tree", tree)
        return out

    return samples.groupBy("tree").applyInPandas(build, TREE_SCHEMA)


def score_vectors(vectors: DataFrame, names: list[str], nodes: DataFrame, size: int) -> DataFrame:
    """Add ``s`` = -2^(-E[h]/c(size)); the forest (trees * 2 * size nodes at most) goes to every task."""
    table = nodes.toPandas()
    trees = int(table["tree"].max()) + 1
    width = int(table["node"].max()) + 1
    feature = np.full((trees, width), -1, dtype=np.int16)
    cut = np.zeros((trees, width))
    length = np.zeros((trees, width))
    at = (table["tree"].to_numpy(), table["node"].to_numpy())
    feature[at], cut[at], length[at] = table["feature"], table["cut"], table["length"]
    grown = np.unique(table["tree"].to_numpy())
    forest = vectors.sparkSession.sparkContext.broadcast((feature[grown], cut[grown], length[grown]))
    norm = average_path(size)
    schema = ", ".join(f"{n} double" for n in names) + ", c bigint, s double"

    def run(batches):
        feature, cut, length = forest.value
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            total = np.zeros(len(x))
            index = np.arange(len(x))
            for f, t, h in zip(feature, cut, length):
                place = np.zeros(len(x), dtype=np.int64)
                while True:
                    used = f[place]
                    inner = used >= 0
                    if not inner.any():
                        break
                    right = x[index, np.maximum(used, 0)] > t[place]
                    place = np.where(inner, 2 * place + 1 + right, place)
                total += h[place]
            depth = total / len(feature)
            yield pdf[[*names, "c"]].assign(s=-np.power(2.0, -depth / norm) if norm else -1.0)

    return vectors.mapInPandas(run, schema)


def detect_isolation_forest(
    df: DataFrame, features: list[str] | None = None, contamination: float = 0.05, trees: int = 200, seed: int = 42,
    max_samples: int = 256,
) -> DataFrame:
    """Flag the rows that are easiest to isolate; the score is lower for worse rows."""
    points, names = with_vectors(df, feature_names(df, features))
    vectors = distinct_vectors(points, names)
    rows = vectors.agg(F.sum("c")).first()[0] or 0
    if rows == 0:
        return df.withColumn("anomaly_iforest", F.lit(False)).withColumn("anomaly_iforest_score", F.lit(0.0))
    size = min(max_samples, rows)
    samples = forest_samples(points, names, rows, trees, size, seed)
    nodes = fit_forest(samples, names, size, seed)
    scores = materialize(score_vectors(vectors, names, nodes, size))
    return flag_scores(points, names, scores, "iforest", contamination, 1.0)
