"""Hard-negative mining by threshold joins in the manner of L2AP.

All rows are packed into blocks by hash; anchors, the stated query set, travel in blocks to every block of rows. Within a
block of rows, dimensions stand in the order of their weight, and the inverted index of a block of anchors omits, for each row, the last dimensions
whose suffix norm alone cannot reach the lowest threshold. Partial scores are accumulated over the index,
a slice of dimensions at a time; rows whose partial score and remaining norm stay below the threshold of every anchor
are pruned; the omitted dimensions of what is left are added from the rows themselves. Thresholds start where a
normal fit of an anchor's scores expects a few more rows than a window needs, and are lowered for windows that did not
fill until they did, or until the window's own lower bound. A window that filled is exact: no row above its
threshold was left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import grouped, shuffle_partitions, stored

#: Dimensions that are accumulated between two prunings.
SLICE = 8
#: Rows that a threshold is expected to let through, as a multiple of the window, round by round; the last round has no threshold.
LOOSENESS = (4, 64)
#: Scores up to here are exact in double precision.
EXACT = float(2**53)

FOUND = "anchor_row long, slot int, row long, vec_id long, score long"
_PACK = "block int, numbers binary, ids binary, labels binary, vectors binary, windows binary"
_RECORD = pa.schema([("block", pa.int32()), *((name, pa.binary()) for name in ("numbers", "ids", "labels", "vectors", "windows"))])
#: Anchors of a block whose scores are fitted at once.
AT_ONCE = 256


def _bytes(values: np.ndarray, kind: str = "<i8") -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    counts = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(counts) and (counts == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(counts), dim), dtype=np.int64)
    if len(flat):
        owner = np.repeat(np.arange(len(counts)), counts)
        out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as they are ordered: null behind all others. The flag keeps a null apart from the greatest long."""
    values = column.fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    missing = column.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.stack([missing, values], axis=1)


def _packed(dim: int, width: int, kind: str):
    """Rows of a block as one record; rows arrive sorted by block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), rows in grouped(batches, ["block"]):
            column = {name: rows[name].combine_chunks() for name in rows.column_names}
            record = {
                "block": int(block), "numbers": _bytes(column["row"].to_numpy()), "ids": _bytes(_ids(column["vec_id"])), "labels": _bytes(column["label"].to_numpy()),
                "vectors": _bytes(_matrix(column["vector"], dim), kind), "windows": _bytes(_matrix(column["window"], width)),
            }
            yield pa.RecordBatch.from_pylist([record], schema=_RECORD)

    return pack


class Rows:
    """A block of rows or anchors."""

    def __init__(self, record: dict, dim: int, kind: str):
        self.numbers = np.frombuffer(record["numbers"], dtype="<i8")
        self.ids = np.frombuffer(record["ids"], dtype="<i8").reshape(-1, 2)
        self.labels = np.frombuffer(record["labels"], dtype="<i8")
        self.whole = np.frombuffer(record["vectors"], dtype=kind).reshape(len(self.numbers), dim)
        self.windows = np.frombuffer(record["windows"], dtype="<i8").reshape(len(self.numbers), -1)

    def by(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in the order of dimensions, and the norms of their suffixes at slice borders."""
        x = self.whole[:, order].astype(np.float64)
        squares = np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1]
        suffix = np.concatenate([np.sqrt(squares[:, ::SLICE]), np.zeros((len(x), 1))], axis=1)
        return x, suffix


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products beyond what doubles hold, cut off at the range of a long."""
    out = q.astype(object) @ x.astype(object).T
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def threshold_scores(anchors: Rows, rows: Rows, lowest: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows for which some anchor can reach its threshold, and their exact scores with all anchors (anchors x rows).

    ``lowest`` is the threshold of each anchor (-inf: none).
    """
    everything = np.arange(len(rows.numbers))
    if not order.size:
        return everything, np.zeros((len(anchors.numbers), len(everything)), dtype=np.int64)
    q, q_suffix = anchors.by(order)
    x, x_suffix = rows.by(order)
    if q_suffix[:, 0].max(initial=0) * x_suffix[:, 0].max(initial=0) >= EXACT:
        return everything, exact_scores(anchors.whole, rows.whole)
    need = lowest - 1e-6 - 1e-9 * np.abs(np.where(np.isinf(lowest), 0, lowest))  # norms are rounded
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(need > 0, need / q_suffix[:, 0], -np.inf)  # a row's norm must reach this
    least = least.min(initial=np.inf) if len(least) else np.inf
    borders = x_suffix.shape[1] - 1
    cut = np.full(len(x), borders) if least == -np.inf else (x_suffix >= least).sum(axis=1)  # slices from here on are not indexed
    by = np.argsort(-cut, kind="stable")
    by = by[cut[by] > 0]  # whole vectors that are too short are not indexed at all
    score = np.zeros((len(q), len(by)))
    alive = by
    for b in range(borders):
        listed = int((cut[alive] > b).sum())  # the list of a slice's dimensions: the first rows
        if listed:
            d = slice(b * SLICE, (b + 1) * SLICE)
            score[:, :listed] += q[:, d] @ x[alive[:listed], d].T
        if least > -np.inf and (b % 2 or b == borders - 1) and len(alive):
            # what a row has not had: the suffix behind this slice, or the omitted one if that begins earlier
            after = np.minimum(b + 1, cut[alive])
            bound = score + q_suffix[:, after] * x_suffix[alive, after][None, :]
            keep = (bound >= need[:, None]).any(axis=0)
            if not keep.all():
                alive, score = alive[keep], score[:, keep]
    for b in range(borders):  # the omitted dimensions of what is left
        from_row = int((cut[alive] > b).sum())
        if from_row < len(alive):
            d = slice(b * SLICE, (b + 1) * SLICE)
            score[:, from_row:] += q[:, d] @ x[alive[from_row:], d].T
    return alive, np.rint(score).astype(np.int64)


def _best(score: np.ndarray, valid: np.ndarray, ids: np.ndarray, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and row of the first k valid rows by score, id and number, for each anchor."""
    a, r = np.nonzero(valid)
    if not len(a):
        return a, r
    if valid.shape[1] > 8 * k:  # ranks are few: rows below the k-th score can go
        low = np.iinfo(np.int64).min
        s = np.where(valid, score, low)
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        keep = score[a, r] >= kth[a]
        a, r = a[keep], r[keep]
    # -score would overflow at the least long; its complement has the same order
    by = np.lexsort((numbers[r], ids[r, 1], ids[r, 0], ~score[a, r], a))
    a, r = a[by], r[by]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    nth = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return a[nth < k], r[nth < k]


def _search(dim: int, kind: str, order: np.ndarray, same: bool, k: int):
    """Per block: the first k rows of each anchor's windows, among rows of its label (not itself) or of other labels.

    A window is a slot, a lower threshold and an upper bound; the anchors' windows follow one another, three numbers each, and a slot
    below 0 is none.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, Rows] = {}
        for batch in batches:
            for record in batch.to_pylist():
                block = record["block"]
                if not record["kind"]:  # the rows of a block arrive before its anchors
                    rows = {block: Rows(record, dim, kind)}
                    continue
                if block not in rows:
                    continue
                yield from found(Rows(record, dim, kind), rows[block])

    def found(anchors: Rows, rows: Rows) -> Iterator[pa.RecordBatch]:
        windows = anchors.windows.reshape(len(anchors.numbers), -1, 3)
        slots, low, high = windows[:, :, 0], windows[:, :, 1], windows[:, :, 2]
        bottom = np.where(slots >= 0, low, np.iinfo(np.int64).max).min(axis=1)
        lowest = np.where(bottom == np.iinfo(np.int64).min, -np.inf, bottom.astype(np.float64))
        at, score = threshold_scores(anchors, rows, lowest, order)
        if not len(at):
            return
        alike = anchors.labels[:, None] == rows.labels[at][None, :]
        own = anchors.numbers[:, None] == rows.numbers[at][None, :]
        allowed = alike & ~own if same else ~alike
        for w in range(windows.shape[1]):
            valid = allowed & (score >= low[:, w, None]) & (score <= high[:, w, None]) & (slots[:, w, None] >= 0)
            a, r = _best(score, valid, rows.ids[at], rows.numbers[at], k)
            if len(a):
                ids = rows.ids[at][r]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors.numbers[a]), pa.array(slots[a, w].astype(np.int32)), pa.array(rows.numbers[at][r]),
                        pa.array(ids[:, 1], mask=ids[:, 0] == 1), pa.array(score[a, r]),
                    ],
                    names=["anchor_row", "slot", "row", "vec_id", "score"],
                )

    return search


def _fit(dim: int, kind: str):
    """Mean and deviation of each anchor's scores with the rows of its block, those of its label and the others."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                rows = Rows(record, dim, kind)
                x = rows.whole.astype(np.float64)
                anchors = np.flatnonzero(rows.windows[:, 0])
                for at in range(0, len(anchors), AT_ONCE):
                    some = anchors[at : at + AT_ONCE]
                    score = x[some] @ x.T
                    alike = rows.labels[some][:, None] == rows.labels[None, :]
                    out = [pa.array(rows.numbers[some])]
                    for mask in (alike & (some[:, None] != np.arange(len(x))[None, :]), ~alike):
                        n = np.maximum(mask.sum(axis=1), 1)
                        mean = np.where(mask, score, 0).sum(axis=1) / n
                        out += [pa.array(mean), pa.array(np.sqrt((np.where(mask, score - mean[:, None], 0) ** 2).sum(axis=1) / n))]
                    yield pa.RecordBatch.from_arrays(out, names=["anchor_row", "same_mean", "same_sd", "other_mean", "other_sd"])

    return fit


_normal = NormalDist()


def _threshold(mean: float, sd: float, rows: float, wanted: float, top: float) -> float:
    """The score above which a normal fit expects ``wanted`` of ``rows`` rows up to ``top``; -inf if that is all of them."""
    if not rows or wanted >= rows or not sd > 0:
        return -math.inf
    above = 1 - _normal.cdf((top - mean) / sd) if top < math.inf else 0.0
    share = above + wanted / rows
    return -math.inf if share >= 1 else mean + sd * _normal.inv_cdf(1 - share)


def _thresholds(kind: str, wanted: float | None):
    """Adds the lower threshold of a window: where the fit expects ``wanted`` rows, but not below the window's floor."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            low = []
            for mean, sd, rows, floor, high in zip(b[f"{kind}_mean"], b[f"{kind}_sd"], b["n_rows"], b["floor"], b["high"], strict=True):
                t = -math.inf if wanted is None else _threshold(mean, sd, rows, wanted, math.inf if high == 2**63 - 1 else float(high))
                low.append(max(int(floor), math.floor(t)) if -(2.0**62) < t < 2.0**62 else int(floor))
            yield b.assign(low=np.array(low, dtype=np.int64))[["anchor_row", "slot", "low", "floor", "high"]]

    return add


class _Join:
    """The stored blocks of rows, and searches of anchors' windows in them."""

    def __init__(self, rows: DataFrame, block_rows: int, anchor_rows: int):
        self.spark: SparkSession = rows.sparkSession
        self.rows, self.anchor_rows = rows, anchor_rows
        size = F.size("vector")
        far = F.array_max(F.transform("vector", lambda x: F.greatest(x, F.bitwise_not(x))))  # -x - 1 has no overflow
        n, dim, anchors, far = rows.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0)), F.count_if("anchor"), F.coalesce(F.max(far), F.lit(0))).first()
        parts = shuffle_partitions(self.spark)
        self.dim, self.n_anchors = int(dim), int(anchors)
        self.kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if far < 2**bits)
        # smaller blocks than asked for where the table is too small to keep all tasks busy; results are the same
        block_rows = max(256, min(block_rows, -(-int(n) // (2 * parts))))
        self.blocks = max(1, -(-int(n) // block_rows))
        self.tasks = max(parts, min(self.blocks, 8 * parts))
        weights = rows.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.sum(F.abs(F.col("x").cast("double"))).alias("w"))
        # one row per dimension
        self.order = np.array([r.d for r in weights.orderBy(F.desc("w"), "d").collect()], dtype=np.int64)
        blocks = self.numbered(rows.withColumn("window", F.array(F.col("anchor").cast("long"))), self.blocks)
        self.packed = stored(blocks.mapInArrow(_packed(self.dim, 1, self.kind), _PACK), "negative-blocks")

    def numbered(self, rows: DataFrame, blocks: int) -> DataFrame:
        spread = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        return spread.repartition(max(shuffle_partitions(self.spark), min(blocks, self.tasks)), "block").sortWithinPartitions("block", "row")

    def fits(self) -> DataFrame:
        return self.packed.mapInArrow(_fit(self.dim, self.kind), "anchor_row long, same_mean double, same_sd double, other_mean double, other_sd double")

    def search(self, windows: DataFrame, width: int, *, same: bool, k: int) -> DataFrame:
        """The first k rows of each window (anchor_row, slot, low, high); at most ``width`` windows an anchor."""
        listed = windows.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))
        none = F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))
        flat = F.flatten(F.transform("w", lambda w: F.array(w["slot"].cast("long"), w["low"], w["high"])))
        fill = F.flatten(F.array_repeat(none, F.lit(width) - F.size("w")))
        anchors = self.rows.where("anchor").join(listed.select(F.col("anchor_row").alias("row"), F.concat(flat, fill).alias("window")), "row")
        blocks = max(1, -(-self.n_anchors // self.anchor_rows))
        queries = self.numbered(anchors, blocks).mapInArrow(_packed(self.dim, 3 * width, self.kind), _PACK)
        queries = stored(queries, "negative-anchors").withColumn("kind", F.lit(1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        both = self.packed.withColumn("kind", F.lit(0)).unionByName(queries)
        both = both.repartition(self.tasks, "block").sortWithinPartitions("block", "kind")
        found = both.mapInArrow(_search(self.dim, self.kind, self.order, same, k), FOUND)
        rank = F.row_number().over(Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def filled(self, windows: DataFrame, *, same: bool, k: int, width: int) -> DataFrame:
        """The first k rows of each window (anchor_row, slot, floor, high, fit), with thresholds that are lowered until windows fill."""
        kind = "same" if same else "other"
        done = None
        for wanted in (*(k * x for x in LOOSENESS), None):
            tried = windows.mapInPandas(_thresholds(kind, wanted), "anchor_row long, slot int, low long, floor long, high long")
            tried = stored(tried, "negative-windows")
            got = stored(self.search(tried, width, same=same, k=k), "negative-found")
            counts = got.groupBy("anchor_row", "slot").agg(F.count("*").alias("n"))
            judged = tried.join(counts, ["anchor_row", "slot"], "left")
            full = (F.coalesce("n", F.lit(0)) >= k) | (F.col("low") <= F.col("floor"))
            complete = got.join(judged.where(full).select("anchor_row", "slot"), ["anchor_row", "slot"], "left_semi")
            done = complete if done is None else done.unionByName(complete)
            windows = stored(windows.join(judged.where(~full).select("anchor_row", "slot"), ["anchor_row", "slot"], "left_semi"), "negative-open")
            if windows.isEmpty():
                break
        return done


def mine_hard_negatives(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    label_col: str = "label",
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    block_rows: int = 8192,
    anchor_rows: int = 256,
) -> DataFrame:
    """Per anchor, positive and rank: a hard negative with both scores.

    ``vector_col`` holds arrays of whole numbers, ``anchor`` says which rows are anchors. Rows with a null label, a null
    vector or a null component take no part. A score is the inner product with the anchor; higher scores come first, ties go to the
    smaller id, null ids last. An anchor's positives are its first ``positives`` other rows of the same label. A positive's
    negatives are the first ``negatives`` rows of other labels whose score lies between ``percent`` of the positive's score and
    all of it, so a negative positive score has none. Fewer are returned where there are fewer.

    Rows with the same id are rows of their own: each of them that is an anchor has its own results, and none is its own positive.
    Vectors of different lengths are compared as if the shorter one ended in zeros; an empty vector scores 0. Scores
    beyond the range of a long are cut off there. An empty table, or one without anchors, gives an empty result; other columns are
    ignored. Memory of a task: one block of rows and one of anchors (``block_rows``, ``anchor_rows``, vectors as longs).
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<long>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(~F.exists("vector", F.isnull), F.lit(False)))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "negative-rows")  # numbers stay as they were written
    join = _Join(rows, block_rows, anchor_rows)

    per_label = rows.groupBy("label").agg(F.count("*").alias("n_label"))
    total = rows.agg(F.count("*").alias("n")).first().n  # one number
    anchors = rows.where("anchor").select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "label")
    anchors = anchors.join(per_label, "label").join(join.fits(), "anchor_row")
    anchors = stored(anchors, "negative-fits")

    fit = ["same_mean", "same_sd", "other_mean", "other_sd"]
    least, most = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    near = anchors.select("anchor_row", F.lit(0).alias("slot"), *fit, F.col("n_label").alias("n_rows"), least.alias("floor"), most.alias("high"))
    found = join.filled(near, same=True, k=positives, width=1)
    found = stored(found.select("anchor_row", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")

    # the least score in the window, rounded up: percent * positive <= 100 * score
    floor = F.ceil(F.col("positive_score").cast("decimal(20,0)") * percent / 100).cast("long")
    open_ = found.join(anchors.select("anchor_row", "n_label", *fit), "anchor_row").where(floor <= F.col("positive_score"))
    windows = open_.select("anchor_row", "slot", *fit, (F.lit(total) - F.col("n_label")).alias("n_rows"), floor.alias("floor"), F.col("positive_score").alias("high"))
    got = join.filled(stored(windows, "negative-slots"), same=False, k=negatives, width=positives)
    named = got.select("anchor_row", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = named.join(found, ["anchor_row", "slot"]).join(anchors.select("anchor_row", "anchor_id"), "anchor_row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
