"""Segments and anomalies of every search at once: one job, however many searches there are.

Rows collapse to (search, price, count). A search is judged on its distinct prices:

* three price segments by the optimal cuts of the sorted prices (prefix sums give the cost of every segment), the best that
  k-means in one dimension can reach;
* the isolation score from expected path lengths. In one dimension the cut that separates two neighbours comes
  before all cuts nearer to a price with a probability of gap / distance, so the mean depth over all random trees on
  a sample has a closed form, and no tree is grown.

Searches of up to ``most`` distinct prices are whole in one task, many side by side. Larger ones are split: their segments come
from a histogram's optimal cuts, improved by Lloyd steps over all distinct prices until nothing moves, and their prices are
scored in blocks against the search's samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import half_even
from ..session import materialize
from .distribution import quantiles

NAMES = ["Économique", "Intermédiaire", "Premium"]
SEGMENTS = len(NAMES)
#: Rows of a search below which it has no segments, no anomalies.
LEAST_SEGMENT_ROWS, LEAST_ANOMALY_ROWS = 3, 5
#: Rows of a tree's sample, and samples of a search that has more rows than one holds.
SAMPLE_ROWS, SAMPLES = 256, 25
#: Bins of the histogram from which large searches start, and the most Lloyd steps after it.
BINS, STEPS = 2048, 50
#: Distinct prices of a large search that are scored together.
BLOCK = 1 << 14
#: Elements of an intermediate matrix.
AT_ONCE = 1 << 22

JUDGED = "search_id long, price double, c long, n long, mean double, sd double, cluster_id int, score double, flagged boolean"


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    many = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many))


def expected_depths(values: np.ndarray, points: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Expected depth at which a value is isolated from the points of a sample, by groups (one row each).

    ``points`` are the sample's distinct values in rising order, ``copies`` says how many rows of it equal the value.
    """
    below = np.concatenate([np.full_like(points[:, :1], -np.inf), points[:, :-1]], axis=1)[:, None, :]
    above = np.concatenate([points[:, 1:], np.full_like(points[:, :1], np.inf)], axis=1)[:, None, :]
    v, at = values[:, :, None], points[:, None, :]
    gap = at - v
    with np.errstate(divide="ignore", invalid="ignore"):
        right = np.where(gap > 0, 1 - np.maximum(below - v, 0) / gap, 0.0)
        left = np.where(gap < 0, 1 + np.maximum(v - above, 0) / gap, 0.0)
    return (right + left).sum(axis=2) + average_path(copies)


def scores_of(depths: np.ndarray, sample_rows: np.ndarray) -> np.ndarray:
    """-2 ** (-depth / mean depth), with nine digits so that equal prices tie."""
    return np.round(-np.power(2.0, -depths / average_path(sample_rows)), 9)


def best_cuts(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the second and third segment of least loss, for groups of equally many sorted scaled values.

    The loss counts as a share of the variance with nine digits; ties go to the smaller cuts.
    """
    groups, m = z.shape
    sums = [np.concatenate([np.zeros((groups, 1)), np.cumsum(x, axis=1)], axis=1) for x in (c, c * z, c * z * z)]

    def cost(i: slice | int, j: slice | int) -> np.ndarray:
        n, s, q = (x[:, j] - x[:, i] for x in sums)
        return q - s * s / n

    best, first, second = np.full(groups, np.inf), np.ones(groups, dtype=int), np.full(groups, 2)
    rows = np.arange(groups)
    for a in range(1, m - 1):
        b = slice(a + 1, m)
        ones = slice(a, a + 1)
        loss = cost(slice(0, 1), ones) + cost(ones, b) + cost(b, slice(m, m + 1))
        loss = np.rint(loss / sums[0][:, -1:] * 1e9)
        at = loss.argmin(axis=1)
        better = loss[rows, at] < best
        best = np.where(better, loss[rows, at], best)
        first, second = np.where(better, a, first), np.where(better, a + 1 + at, second)
    return first, second


def _percentile(scores: np.ndarray, c: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Interpolated percentile of weighted scores, by groups."""
    by = np.argsort(scores, axis=1, kind="stable")
    ordered, total = np.take_along_axis(scores, by, 1), np.cumsum(np.take_along_axis(c, by, 1), axis=1)
    place = (n - 1) * share
    low = np.floor(place)
    pick = lambda k: np.take_along_axis(ordered, (total <= k[:, None]).sum(axis=1)[:, None], 1)[:, 0]
    lo, hi = pick(low), pick(np.minimum(low + 1, n - 1))
    return lo + (hi - lo) * (place - low)


def judge(x: np.ndarray, c: np.ndarray, mean: np.ndarray, sd: np.ndarray, ids: np.ndarray, contamination: float, seed: int):
    """Segments, scores and flags of searches with equally many distinct prices (one row each)."""
    groups, m = x.shape
    n = c.sum(axis=1)
    cluster = np.zeros((groups, m), dtype=np.int32)
    if m >= SEGMENTS:
        z = (x - mean[:, None]) / np.where(sd > 0, sd, 1.0)[:, None]
        first, second = best_cuts(z, c)
        place = np.arange(m)[None, :]
        cluster = ((place >= first[:, None]).astype(np.int32) + (place >= second[:, None])).astype(np.int32)
    else:
        cluster += np.arange(m, dtype=np.int32)[None, :]
    depths = np.zeros((groups, m))
    whole = n <= SAMPLE_ROWS
    if whole.any():
        step = max(1, AT_ONCE // (m * m))
        at = np.flatnonzero(whole)
        for some in np.split(at, range(step, len(at), step)):
            depths[some] = expected_depths(x[some], x[some], c[some])
    for g in np.flatnonzero(~whole):
        draw = np.random.default_rng([seed, int(ids[g]) & (2**63 - 1)])
        for _ in range(SAMPLES):
            drawn = draw.multivariate_hypergeometric(c[g], SAMPLE_ROWS, method="marginals")
            depths[g] += expected_depths(x[g][None], x[g][drawn > 0][None], np.maximum(drawn, 1)[None])[0] / SAMPLES
    scores = scores_of(depths, np.minimum(n, SAMPLE_ROWS)[:, None])
    flagged = scores < _percentile(scores, c, n, contamination)[:, None]
    return cluster, scores, flagged


def _judged(contamination: float, seed: int):
    def of(rows: pd.DataFrame) -> pa.RecordBatch:
        ids = rows["search_id"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sizes = np.diff(np.append(first, len(ids)))
        x, c, n = rows["price"].to_numpy(), rows["c"].to_numpy(), rows["n"].to_numpy()
        cluster, score, flagged = np.zeros(len(ids), dtype=np.int32), np.zeros(len(ids)), np.zeros(len(ids), dtype=bool)
        for m in np.unique(sizes):
            own = first[sizes == m]
            step = max(1, AT_ONCE // int(m))
            for some in np.split(own, range(step, len(own), step)):
                at = some[:, None] + np.arange(m)[None, :]
                cluster[at], score[at], flagged[at] = judge(
                    x[at], c[at], rows["mean"].to_numpy()[some], rows["sd"].to_numpy()[some], ids[some], contamination, seed)
        few, fewer = n < LEAST_ANOMALY_ROWS, n < LEAST_SEGMENT_ROWS
        return pa.RecordBatch.from_pydict({
            **{k: pa.array(rows[k].to_numpy()) for k in ["search_id", "price", "c", "n", "mean", "sd"]},
            "cluster_id": pa.array(cluster, mask=fewer), "score": pa.array(score, mask=few), "flagged": pa.array(flagged & ~few),
        })

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            ids = rows["search_id"].to_numpy()
            other = ids[::-1] != ids[-1]
            open_ = int(other.argmax()) if other.any() else len(ids)  # rows of the last search may go on
            held = rows.iloc[len(rows) - open_:]
            if open_ < len(rows):
                yield of(rows.iloc[: len(rows) - open_])
        if held is not None and len(held):
            yield of(held)

    return judged


def small_searches(values: DataFrame, contamination: float, seed: int) -> DataFrame:
    """Judged prices of searches that are whole in a task."""
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = values.select("search_id", "price", "c", "n", "mean", "sd")
    return rows.repartition(tasks, "search_id").sortWithinPartitions("search_id", "price").mapInArrow(_judged(contamination, seed), JUDGED)


# --- searches with many distinct prices ---------------------------------------------------


def _placed(price: Column, centers: Column) -> Column:
    """Segment of a price: how many midpoints of neighbouring centres lie at or below it."""
    return sum(
        (F.when(price >= (centers[i] + centers[i + 1]) / 2, 1).otherwise(0) for i in range(SEGMENTS - 1)), F.lit(0)
    ).cast("int")


def _first_centers(values: DataFrame) -> DataFrame:
    """(search_id, centers) from the optimal cuts of each search's histogram of means."""
    share = (F.col("price") - F.col("lowest")) / (F.col("highest") - F.col("lowest"))
    bins = values.groupBy("search_id", "mean", "sd", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("b")).agg(
        F.sum("c").alias("c"), (F.sum(F.col("price") * F.col("c")) / F.sum("c")).alias("price"))

    def centers(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("b")
        x, c = rows["price"].to_numpy(), rows["c"].to_numpy()
        cuts = [0, len(x), len(x)]
        if len(x) >= SEGMENTS:
            cuts = [0, *(int(k[0]) for k in best_cuts(((x - rows["mean"]) / rows["sd"]).to_numpy()[None], c[None]))]
        parts = np.split(np.arange(len(x)), cuts[1:])
        means = [float(np.average(x[p], weights=c[p])) if len(p) else float(x[-1]) for p in parts]
        return pd.DataFrame({"search_id": rows["search_id"].iloc[:1], "centers": [means]})

    # a group holds at most as many rows as there are bins
    return bins.groupBy("search_id").applyInPandas(centers, "search_id long, centers array<double>")


def _lloyd(values: DataFrame) -> DataFrame:
    """(search_id, centers) after Lloyd steps for all large searches side by side."""
    centers = materialize(_first_centers(values))
    for _ in range(STEPS):
        placed = values.join(centers, "search_id").withColumn("cluster_id", _placed(F.col("price"), F.col("centers")))
        means = placed.groupBy("search_id", "cluster_id").agg((F.sum(F.col("price") * F.col("c")) / F.sum("c")).alias("m"))
        found = means.groupBy("search_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "m"))).alias("found"))
        joined = centers.withColumnRenamed("centers", "old").join(found, "search_id")
        new = F.array(*[F.coalesce(F.try_element_at("found", F.lit(i)), F.get("old", F.lit(i))) for i in range(SEGMENTS)])
        moved = F.exists(F.zip_with("old", new, lambda a, b: F.abs(a - b) > 1e-9 * F.abs(a)), lambda x: x)
        step = materialize(joined.select("search_id", new.alias("centers"), moved.alias("moved")))
        centers = step.select("search_id", "centers")
        if not step.where("moved").limit(1).count():
            break
    return centers


def _samples(values: DataFrame, seed: int) -> DataFrame:
    """(search_id, sample, points): samples of a search's rows in hash order, as sorted prices; a few thousand rows of each search."""
    wanted = SAMPLES * SAMPLE_ROWS
    rows = values.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("c"), F.lit(wanted).cast("long")))))
    # a price that has more copies than all samples hold is drawn by its weight: its copies' hashes shrink
    weight = F.greatest(F.col("c") / wanted, F.lit(1.0))
    u = (F.abs(F.xxhash64("search_id", "price", "copy", F.lit(seed)) % (1 << 52)) / float(1 << 52)) / weight
    drawn = rows.withColumn("u", u).where(F.col("u") < 3.0 * wanted / F.col("n"))
    order = Window.partitionBy("search_id").orderBy("u", "price", "copy")
    ranked = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= wanted)
    return ranked.groupBy("search_id", (F.col("r") % SAMPLES).alias("sample")).agg(F.sort_array(F.collect_list("price")).alias("points"))


def _large_scores(values: DataFrame, seed: int) -> DataFrame:
    """(search_id, price, c, score) in blocks of prices: samples travel to every block of their search."""
    blocks = F.ceil(F.col("m") / BLOCK)
    samples = _samples(values, seed).join(values.select("search_id", blocks.alias("blocks")).distinct(), "search_id")
    samples = samples.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    samples = samples.groupBy("search_id", "block").agg(F.collect_list("points").alias("samples"))
    spread = values.withColumn("block", F.pmod(F.xxhash64("price"), blocks))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b))
            for _, rows in b.reset_index(drop=True).groupby(["search_id", "block"], sort=False):
                x, at = rows["price"].to_numpy(), rows.index.to_numpy()
                for sample in rows["samples"].iloc[0]:
                    points, copies = np.unique(np.asarray(sample), return_counts=True)
                    place = np.minimum(np.searchsorted(points, x), len(points) - 1)
                    own = np.where(points[place] == x, copies[place], 1)
                    for some in np.split(np.arange(len(x)), range(4096, len(x), 4096)):
                        out[at[some]] += expected_depths(x[some][None], points[None], own[some][None])[0] / len(rows["samples"].iloc[0])
            yield b[["search_id", "price", "c"]].assign(score=scores_of(out, np.array(SAMPLE_ROWS)))

    joined = spread.select("search_id", "price", "c", "block").join(samples, ["search_id", "block"])
    return joined.mapInPandas(scored, "search_id long, price double, c long, score double")


def large_searches(values: DataFrame, contamination: float, seed: int) -> DataFrame:
    """Judged prices of searches that are split over tasks."""
    placed = values.join(_lloyd(values), "search_id").withColumn("cluster_id", _placed(F.col("price"), F.col("centers")))
    scores = materialize(_large_scores(values, seed))
    cut = quantiles(scores, ["search_id"], "score", {"cut": contamination}, weight="c")
    judged = scores.join(cut, "search_id").select("search_id", "price", "score", (F.col("score") < F.col("cut")).alias("flagged"))
    return placed.join(judged, ["search_id", "price"]).select("search_id", "price", "c", "n", "mean", "sd", "cluster_id", "score", "flagged")


def judged_prices(prices: DataFrame, contamination: float = 0.05, seed: int = 42, most: int = 4096) -> DataFrame:
    """Distinct prices per search with rows, segment, score and flag.

    Rows without a search or price, and prices that are not finite, take no part. Searches of fewer than two rows are left out; segments need
    three rows, anomalies five. The result is written once.
    """
    price = F.col("price").cast("double")
    known = F.col("search_id").isNotNull() & price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf"))
    counts = prices.where(known).groupBy(F.col("search_id").cast("long").alias("search_id"), price.alias("price")).agg(F.count(F.lit(1)).alias("c"))
    weighted = F.sum(F.col("price") * F.col("c"))
    whole = counts.groupBy("search_id").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("m"), (weighted / F.sum("c")).alias("mean"), F.min("price").alias("lowest"), F.max("price").alias("highest"))
    whole = whole.where(F.col("n") >= 2)
    values = counts.join(whole, "search_id")
    square = (F.col("price") - F.col("mean")) * (F.col("price") - F.col("mean")) * F.col("c")
    spread = values.groupBy("search_id").agg(F.sqrt(F.sum(square) / F.sum("c")).alias("sd"))
    values = materialize(values.join(spread, "search_id"))
    judged = small_searches(values.where(F.col("m") <= most), contamination, seed)
    large = values.where(F.col("m") > most)
    if large.limit(1).count():
        judged = judged.unionByName(large_searches(large, contamination, seed))
    return materialize(judged)


def search_clusters(judged: DataFrame) -> DataFrame:
    """Segments of each search by rising price: name, scaled centre, mean, bounds and rows."""
    segments = judged.where(F.col("cluster_id").isNotNull()).groupBy("search_id", "cluster_id").agg(
        F.sum("c").alias("rows"), F.min("price").alias("lowest"), F.max("price").alias("highest"),
        (F.sum(F.col("price") * F.col("c")) / F.sum("c")).alias("_mean"), F.first("mean").alias("_all"), F.first("sd").alias("_sd"))
    names = F.array(*[F.lit(n) for n in NAMES])
    center = (F.col("_mean") - F.col("_all")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    return segments.select(
        "search_id", "cluster_id", F.get(names, F.col("cluster_id")).alias("name"), half_even(center, 6).alias("center"),
        half_even(F.col("_mean"), 2).alias("mean_price"), "lowest", "highest", "rows")


def search_flagged(prices: DataFrame, judged: DataFrame) -> DataFrame:
    """Offers whose price is flagged in their search, with the score."""
    flags = judged.where("flagged").select("search_id", F.col("price").alias("_p"), "score")
    keyed = prices.withColumns({"search_id": F.col("search_id").cast("long"), "_p": F.col("price").cast("double")})
    return keyed.join(flags, ["search_id", "_p"]).drop("_p").withColumn("score", half_even(F.col("score"), 4))


def search_reports(judged: DataFrame) -> DataFrame:
    """One row per search: rows, centres and names of its segments by rising price, number of flagged offers.

    Arrays are empty where a search is too small; the flagged offers themselves are in ``search_flagged``.
    """
    centers = search_clusters(judged).groupBy("search_id").agg(
        F.array_sort(F.collect_list(F.struct("cluster_id", "center", "name"))).alias("s"))  # three at most
    rows = judged.groupBy("search_id").agg(F.sum("c").alias("count"), F.sum(F.when(F.col("flagged"), F.col("c")).otherwise(F.lit(0))).alias("anomaly_count"))
    return rows.join(centers, "search_id", "left").select(
        "search_id", "count", F.coalesce(F.col("s.center"), F.array().cast("array<double>")).alias("centers"),
        F.coalesce(F.col("s.name"), F.array().cast("array<string>")).alias("cluster_names"), "anomaly_count")
