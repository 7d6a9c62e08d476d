"""Exact quality of clusters over several features: mean Euclidean silhouette and Davies-Bouldin index.

Rows collapse to distinct vectors with counts. Vectors are dealt into blocks by hash; every block meets every other one once,
as two bounded matrices, and adds up its vectors' distances to each cluster. So no pair of vectors is ever a row, several
labellings share the distances, and a task holds two blocks. The number of distances is the square of the number of
distinct vectors, as the measure asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import half_even
from ..session import materialize

BLOCK_ROWS = 2048
_SUMS = "labelling int, score double"


def _array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _pack(names: list[str], labels: list[str]):
    """One record per block; rows arrive sorted by block."""

    def record(block: int, rows: pa.Table) -> pa.RecordBatch:
        x = np.stack([_array(rows[n].combine_chunks()) for n in names], axis=1).astype("<f8")
        y = np.stack([_array(rows[n].combine_chunks()) for n in labels], axis=1).astype("<i4")
        c = _array(rows["c"].combine_chunks()).astype("<i8")
        columns = [pa.array([block], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, y, c))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "x", "y", "c"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            blocks = _array(batch["block"])
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if held and blocks[a] != at:
                    yield record(at, pa.Table.from_batches(held))
                    held = []
                at = int(blocks[a])
                held.append(batch.slice(a, z - a))
        if held:
            yield record(at, pa.Table.from_batches(held))

    return pack


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences are taken before squaring, so that near vectors keep their digits."""
    total = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        total += (a[:, f, None] - b[None, :, f]) ** 2
    return np.sqrt(total)


def _silhouettes(width: int, clusters: list[np.ndarray], sizes: list[np.ndarray]):
    """Sum of the silhouettes of a block's rows for each labelling; a block's own record comes before the others."""
    count = len(clusters)

    def of(record: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = np.frombuffer(record["c"], dtype="<i8")
        x = np.frombuffer(record["x"], dtype="<f8").reshape(len(c), width)
        y = np.frombuffer(record["y"], dtype="<i4").reshape(len(c), count)
        return x, np.stack([np.searchsorted(clusters[i], y[:, i]) for i in range(count)], axis=1), c

    def score(y: np.ndarray, c: np.ndarray, total: np.ndarray, size: np.ndarray) -> float:
        at = np.arange(len(y))
        own = size[y]
        inner = total[at, y] / np.maximum(own - 1, 1)
        mean = total / size[None, :]
        mean[at, y] = np.inf
        near = mean.min(axis=1)
        top = np.maximum(inner, near)
        s = np.where((own > 1) & np.isfinite(near) & (top > 0), (near - inner) / np.where(top > 0, top, 1), 0.0)
        return float((s * c).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, sums, block = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if mine is not None:
                _, y, c = mine
                scores = [score(y[:, i], c, sums[i], sizes[i]) for i in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(scores)], names=["labelling", "score"])

        for batch in batches:
            for record in batch.to_pylist():
                if record["block"] != block:
                    yield from done()
                    block, mine = record["block"], of(record)
                    sums = [np.zeros((len(mine[0]), len(clusters[i]))) for i in range(count)]
                    continue
                x, y, c = of(record)
                d = _distances(mine[0], x)
                for i in range(count):
                    weights = np.zeros((len(c), len(clusters[i])))
                    weights[np.arange(len(c)), y[:, i]] = c
                    sums[i] += d @ weights
        yield from done()

    return run


def _distance(names: list[str], other: str) -> Column:
    return F.sqrt(sum(((F.col(n) - F.col(f"{other}.{n}")) * (F.col(n) - F.col(f"{other}.{n}")) for n in names), F.lit(0.0)))


def davies_bouldin(vectors: DataFrame, names: list[str], label: str) -> DataFrame:
    """One row: the index of weighted clusters; 0 for a single one.

    Clusters with the same centre count as no rivals.
    """
    means = vectors.groupBy(F.col(label).alias("cluster")).agg(*[(F.sum(F.col(n) * F.col("c")) / F.sum("c")).alias(n) for n in names])
    centers = means.select("cluster", F.struct(*names).alias("m"))
    spread = vectors.join(centers, F.col(label) == F.col("cluster")).groupBy("cluster", "m").agg(
        (F.sum(_distance(names, "m") * F.col("c")) / F.sum("c")).alias("s"))
    table = spread.agg(F.collect_list(F.struct("cluster", "m", "s")).alias("t"))  # a row per cluster

    def apart(a: Column, b: Column) -> Column:
        return F.sqrt(sum(((a["m"][n] - b["m"][n]) * (a["m"][n] - b["m"][n]) for n in names), F.lit(0.0)))

    worst = F.transform("t", lambda a: F.array_max(F.transform(
        F.filter("t", lambda b: b["cluster"] != a["cluster"]), lambda b: F.try_divide(a["s"] + b["s"], apart(a, b)))))
    total = F.aggregate(worst, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return table.select(F.try_divide(total, F.size("t")).alias("davies_bouldin"))


def vector_quality(points: DataFrame, names: list[str], labels: list[str], block_rows: int = BLOCK_ROWS, weight: str | None = None) -> DataFrame:
    """Per label column: clusters, rows, smallest cluster, silhouette and Davies-Bouldin index.

    ``names`` are feature columns, ``labels`` columns of whole cluster numbers, ``weight`` a column of row counts. Rows with a missing feature or label take no part. Rows of
    a cluster of one score 0, and so does a single cluster. An empty table gives an empty result.
    """
    known = [F.col(n).cast("double").alias(n) for n in names] + [F.col(c).cast("int").alias(c) for c in labels]
    weights = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = points.select(*known, weights.alias("c")).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*names, *labels]))
    vectors = materialize(rows.groupBy(*names, *labels).agg(F.sum("c").alias("c")))
    spark = points.sparkSession
    distinct = vectors.count()
    schema = "labelling string, clusters int, rows long, smallest long, silhouette double, davies_bouldin double"
    if not distinct:
        return spark.createDataFrame([], schema)
    # a row per cluster of each labelling
    members = [vectors.groupBy(c).agg(F.sum("c").alias("n")).orderBy(c).collect() for c in labels]
    clusters = [np.array([r[0] for r in m], dtype=np.int64) for m in members]
    sizes = [np.array([r["n"] for r in m], dtype=float) for m in members]

    blocks = -(-distinct // block_rows)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 4096))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64(*names, *labels), F.lit(blocks)).cast("int"))
    packed = dealt.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_pack(names, labels), "block int, x binary, y binary, c binary")
    packed = materialize(packed)
    met = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = packed.withColumn("kind", F.lit(0)).unionByName(met.withColumn("kind", F.lit(1)))
    sums = both.repartition(tasks, "block").sortWithinPartitions("block", "kind").drop("kind").mapInArrow(_silhouettes(len(names), clusters, sizes), _SUMS)
    scores = sums.groupBy("labelling").agg(F.sum("score").alias("score"))

    facts = spark.createDataFrame(
        [(i, c, len(clusters[i]), int(sizes[i].sum()), int(sizes[i].min())) for i, c in enumerate(labels)],
        "i int, labelling string, clusters int, rows long, smallest long")
    index = davies_bouldin(vectors, names, labels[0]).withColumn("j", F.lit(0))
    for i, c in enumerate(labels[1:], 1):
        index = index.unionByName(davies_bouldin(vectors, names, c).withColumn("j", F.lit(i)))
    scores = scores.withColumnRenamed("labelling", "i")
    return facts.join(scores, "i").join(index, F.col("i") == F.col("j")).select(
        "labelling", "clusters", "rows", "smallest", (half_even(F.col("score") / F.col("rows"), 4) + 0.0).alias("silhouette"),
        half_even(F.col("davies_bouldin"), 4).alias("davies_bouldin"))
