"""Exact nearest neighbours of weighted vectors, by cells of a k-d tree.

A bounded sample gives the cuts; every vector goes to the cell it falls into. A cell finds the neighbours of its vectors among
themselves, which bounds how far the k-th one can be. Vectors whose ball reaches into the box of another cell are sent there and
only there, with that bound, and the results are merged. Within a cell, vectors stand in small k-d blocks; a block meets only the blocks
that its balls can touch. No table of all vectors, or of their combinations, is gathered anywhere: the driver sees the sample and one box per cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import free_finished, shared_folder, stored, stored_at

#: Vectors that a cell should hold, the most cells, and vectors of the sample that the cuts are read from.
CELL_VECTORS, MOST_CELLS, SAMPLE = 8192, 4096, 32768
#: Vectors of a block within a cell.
BLOCK = 256
#: Digits of a distance; equal distances tie, and ties go to the smaller coordinates.
DIGITS = 10
#: Distances that are held at once.
AT_ONCE = 1 << 22

FOUND = "id long, other long, free long, dist double, open boolean"  # and the coordinates of the other vector, where open


def kd_cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and cut of each inner node in heap order: the median along the widest side."""
    dims, cuts = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
    todo = [(0, sample)]
    while todo:
        node, rows = todo.pop()
        if node >= len(cuts) or len(rows) < 2:
            continue
        dim = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
        cut = float(np.median(rows[:, dim]))
        left = rows[:, dim] <= cut
        if left.all():  # the median is the greatest value
            left = rows[:, dim] < cut
            cut = float(rows[left, dim].max()) if left.any() else np.inf
        dims[node], cuts[node] = dim, cut
        todo += [(2 * node + 1, rows[rows[:, dim] <= cut]), (2 * node + 2, rows[rows[:, dim] > cut])]
    return dims, cuts


def cells_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    at = np.arange(len(x))
    while len(cuts) and (node < len(cuts)).all():
        node = 2 * node + 1 + (x[at, dims[node]] > cuts[node])
    return node - len(cuts)


def blocks_of(x: np.ndarray, size: int = BLOCK) -> list[np.ndarray]:
    """Places of vectors that are near one another."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        rows = x[at]
        dim = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
        half = np.argpartition(rows[:, dim], len(at) // 2)
        todo += [at[half[len(at) // 2 :]], at[half[: len(at) // 2]]]
    return [b for b in out if len(b)]


def box_distances(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least distances from boxes (or points) to other boxes."""
    gap = np.maximum(np.maximum(lows[None] - high[:, None], low[:, None] - highs[None]), 0)
    return np.sqrt((gap**2).sum(axis=2))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; differences are taken before squaring, so that near vectors keep their digits."""
    total = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        gap = a[:, f, None] - b[None, :, f]
        total += np.multiply(gap, gap, out=gap)
    return total


def reaches(square: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th row for each query, a last digit more; inf where fewer rows are there."""
    if not square.shape[1]:
        return np.full(len(square), np.inf)
    some = min(k, square.shape[1]) - 1  # k vectors hold k rows at least
    near = np.argpartition(square, some, axis=1)[:, : some + 1]
    d = np.take_along_axis(square, near, 1)
    c = np.where(np.isinf(d), 0, np.take_along_axis(copies, near, 1))
    by = np.argsort(d, axis=1)
    d, c = np.take_along_axis(d, by, 1), np.cumsum(np.take_along_axis(c, by, 1), axis=1)
    enough = c >= k
    return np.where(enough.any(axis=1), np.sqrt(d[np.arange(len(d)), enough.argmax(axis=1)]) + 2 * 10.0**-DIGITS, np.inf)


def nearest(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int):
    """(query, place, free copies, distance) of the vectors that can be among the k nearest rows of each query, and the queries' reaches.

    A query that is itself in ``x`` has one copy less there. Rows beyond a query's ``bound`` are left out; vectors at
    the distance of the k-th row all stay, so that ties are settled in one place.
    """
    found, reach = [], np.full(len(q), np.inf)
    if not len(q) or not len(x):
        return found, reach
    blocks = blocks_of(x)
    lows, highs = np.stack([x[b].min(axis=0) for b in blocks]), np.stack([x[b].max(axis=0) for b in blocks])
    ends = np.cumsum([len(b) for b in blocks])
    places = np.concatenate(blocks)
    y, y_ids, y_c = x[places], ids[places], c[places]  # blocks are slices now
    slices = [slice(z - len(b), z) for b, z in zip(blocks, ends.tolist())]

    def measure(own: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([np.arange(slices[b].start, slices[b].stop) for b in some])
        square = squares(q[own], y[at])
        free = np.broadcast_to(y_c[at][None, :], square.shape)
        same = q_ids[own][:, None] == y_ids[at][None, :]
        if same.any():
            free = free - same
            square[free <= 0] = np.inf
        return at, square, free

    for own in blocks_of(q):
        apart = box_distances(q[own].min(axis=0)[None], q[own].max(axis=0)[None], lows, highs)[0]
        order = np.argsort(apart, kind="stable")
        held = np.cumsum(np.diff(ends, prepend=0)[order])
        _, square, free = measure(own, order[: int(np.searchsorted(held, 2 * k)) + 1])
        limit = np.minimum(reaches(square, free, k), bound[own])
        # queries of like reach go together, so that a lonely one does not widen the search of the others
        for part in np.array_split(np.argsort(limit, kind="stable"), max(1, len(own) // 32)):
            queries = own[part]
            boxes = box_distances(q[queries].min(axis=0)[None], q[queries].max(axis=0)[None], lows, highs)[0]
            near = np.flatnonzero(boxes <= limit[part].max())
            if not len(near):
                reach[queries] = limit[part]
                continue
            step = max(1, AT_ONCE // int(np.diff(ends, prepend=0)[near].sum()))
            for some in np.split(np.arange(len(part)), range(step, len(part), step)):
                at, square, free = measure(queries[some], near)
                top = np.minimum(reaches(square, free, k), limit[part][some])
                reach[queries[some]] = top
                a, b = np.nonzero(square <= (top * top)[:, None])
                if len(a) and np.isinf(top).any():
                    real = np.isfinite(square[a, b])
                    a, b = a[real], b[real]
                found.append((queries[some][a], places[at[b]], free[a, b], np.round(np.sqrt(square[a, b]), DIGITS)))
    return found, reach


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each cell; they arrive sorted by cell."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        cells = batch["cell"].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            if held and cells[a] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(cells[a])
            held.append(batch.slice(a, z - a))
    if held:
        yield at, pa.Table.from_batches(held)


def _columns(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table[n].to_numpy() for n in names], axis=1)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _named(x: np.ndarray, names: list[str]) -> dict[str, np.ndarray]:
    return {n: np.ascontiguousarray(x[:, i]) for i, n in enumerate(names)}


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``id``: the cell and the place within it, in the order of coordinates."""
    for cell, rows in _grouped(batches):
        ids = (cell << 40) + np.arange(rows.num_rows)
        yield from rows.append_column("id", pa.array(ids)).to_batches()


def touched(x: np.ndarray, own: np.ndarray, reach: np.ndarray, cells: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of vectors and of the other cells whose boxes their balls touch, some vectors at a time."""
    step = max(1, AT_ONCE // (len(cells) * x.shape[1]))
    for some in np.split(np.arange(len(x)), range(step, len(x), step)):
        apart = box_distances(x[some], x[some], lows, highs)
        a, b = np.nonzero((apart <= reach[some][:, None] + 10.0**-DIGITS) & (cells[None, :] != own[some][:, None]))
        yield some[a], b


def first_rows(query: np.ndarray, free: np.ndarray, dist: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that hold the first k rows of each query, by distance and then coordinates, and the rows taken of each."""
    order = np.lexsort((*y.T[::-1], dist, query))
    query, free = query[order], free[order]
    total = np.cumsum(free) - free
    start = np.maximum.accumulate(np.where(np.diff(query, prepend=-1) != 0, np.arange(len(query)), 0))
    before = total - total[start]
    held = before < k
    return order[held], np.minimum(free, k - before)[held]


def _within(names: list[str], k: int, cells: np.ndarray, lows: np.ndarray, highs: np.ndarray):
    """The k nearest rows within a cell, final unless a vector's ball touches another cell: then its rows are open, and ``other`` of -1 marks its reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _grouped(batches):
            x, ids, c = _columns(rows, names), rows["id"].to_numpy(), rows["c"].to_numpy()
            found, reach = nearest(x, ids, np.full(len(x), np.inf), x, ids, c, k)
            is_open = np.zeros(len(x), dtype=bool)
            for a, _ in touched(x, np.full(len(x), cell), reach, cells, lows, highs):
                is_open[a] = True
            at = np.flatnonzero(is_open)
            yield _batch({"id": ids[at], "other": np.full(len(at), -1), "free": np.zeros(len(at), dtype=np.int64), "dist": reach[at], "open": is_open[at], **_named(x[at], names)})
            for a, b, free, dist in found:
                place, free = first_rows(a, free, dist, x[b], k)
                a, b = a[place], b[place]
                named = {n: np.where(is_open[a], v, 0.0) for n, v in _named(x[b], names).items()}
                yield _batch({"id": ids[a], "other": ids[b], "free": free, "dist": dist[place], "open": is_open[a], **named})

    return run


def _sent(names: list[str], cells: np.ndarray, lows: np.ndarray, highs: np.ndarray):
    """Rows (cell, id, coordinates, reach) for every other cell whose box a vector's ball touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch[n].to_numpy(zero_copy_only=False) for n in names], axis=1)
            own, reach, ids = (batch[n].to_numpy(zero_copy_only=False) for n in ("cell", "reach", "id"))
            for at, b in touched(x, own, reach, cells, lows, highs):
                yield _batch({"cell": cells[b], "id": ids[at], "reach": reach[at], **_named(x[at], names)})

    return run


def _across(names: list[str], k: int):
    """Neighbours of the vectors that were sent to a cell, among the vectors of that cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            sent = rows["sent"].to_numpy()
            x, ids, c = _columns(rows, names), rows["id"].to_numpy(), rows["c"].to_numpy()
            own = ~sent
            found, _ = nearest(x[sent], ids[sent], rows["reach"].to_numpy()[sent], x[own], ids[own], c[own], k)
            for a, b, free, dist in found:
                yield _batch({"id": ids[sent][a], "other": ids[own][b], "free": free, "dist": dist, "open": np.ones(len(a), dtype=bool), **_named(x[own][b], names)})

    return run


def placed_vectors(vectors: DataFrame, names: list[str], cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """Vectors (names, c) with their cell and an id, written once."""
    spark = vectors.sparkSession
    n = vectors.count()
    depth = max(0, int(np.ceil(np.log2(max(1, min(MOST_CELLS, n / cell_vectors))))))
    share = min(1.0, SAMPLE / max(n, 1))
    unit = F.abs(F.xxhash64(*names) % (1 << 40)) / float(1 << 40)
    drawn = vectors.where(unit <= share).select(*names).limit(2 * SAMPLE).toPandas().to_numpy(dtype=float)
    dims, cuts = kd_cuts(drawn[np.lexsort(drawn.T)], depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch[name].to_numpy(zero_copy_only=False) for name in names], axis=1)
            yield batch.append_column("cell", pa.array(cells_of(x, dims, cuts)))

    fields = ", ".join(f"{name} double" for name in names) + ", c long, cell long"
    rows = vectors.select(*names, F.col("c").cast("long").alias("c")).mapInArrow(run, fields)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2**depth, MOST_CELLS))
    dealt = rows.repartition(tasks, "cell").sortWithinPartitions("cell", *names)
    return stored(dealt.mapInArrow(_numbered, fields + ", id long"), "near-placed")


def nearest_rows(placed: DataFrame, names: list[str], k: int, path: str | None = None) -> DataFrame:
    """(id, other, copies, dist): the k nearest other rows of every vector; a vector takes only the copies needed.

    Exact; ties at the k-th place go to the vector with the smaller coordinates. Written once, to ``path`` if it is given: only
    vectors whose ball leaves their cell are shuffled with their rows.
    """
    spark = placed.sparkSession
    count = placed.agg(F.max("cell")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(count) + 1)
    boxes = placed.groupBy("cell").agg(*[F.min(n).alias(f"a{i}") for i, n in enumerate(names)], *[F.max(n).alias(f"z{i}") for i, n in enumerate(names)])
    box = boxes.orderBy("cell").toPandas()  # a row per cell, MOST_CELLS at most
    cells = box["cell"].to_numpy()
    lows, highs = (box[[f"{side}{i}" for i in range(len(names))]].to_numpy(dtype=float).reshape(-1, len(names)) for side in "az")

    sorted_ = placed.repartition(tasks, "cell").sortWithinPartitions("cell", "id")
    schema = FOUND + "".join(f", {n} double" for n in names)
    within = shared_folder(spark, "near-within")
    inner = stored_at(sorted_.mapInArrow(_within(names, k, cells, lows, highs), schema), within)
    reach = inner.where("other = -1").select("id", F.col("dist").alias("reach"))
    fields = "cell long, id long, reach double, " + ", ".join(f"{n} double" for n in names)
    asked = placed.join(reach, "id").mapInArrow(_sent(names, cells, lows, highs), fields)
    asked = asked.select("cell", "id", "reach", *names, F.lit(0).cast("long").alias("c"), F.lit(True).alias("sent"))
    data = placed.select("cell", "id", F.lit(0.0).alias("reach"), *names, "c", F.lit(False).alias("sent"))
    both = data.unionByName(asked).repartition(tasks, "cell").sortWithinPartitions("cell", "sent", "id")
    found = inner.where("other >= 0 AND open").unionByName(both.mapInArrow(_across(names, k), schema))

    order = Window.partitionBy("id").orderBy("dist", *names).rowsBetween(Window.unboundedPreceding, -1)
    taken = found.withColumn("_t", F.coalesce(F.sum("free").over(order), F.lit(0))).where(F.col("_t") < k)
    merged = taken.select("id", "other", F.least(F.col("free"), k - F.col("_t")).alias("copies"), "dist")
    final = inner.where("other >= 0 AND NOT open").select("id", "other", F.col("free").alias("copies"), "dist")
    near = stored_at(final.unionByName(merged), path or shared_folder(spark, "near"))
    free_finished(spark, within)  # many times as large as the vectors, and read by nothing else
    return near
