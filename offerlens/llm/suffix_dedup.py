"""Removal of long byte strings that start earlier in the corpus, by suffix arrays of sampled suffixes.

Every string of ``length`` bytes has an anchor: the place of the smallest hash among its ``seed_bytes``-byte pieces. Equal
strings have equal anchors at equal offsets, so comparing the surroundings of anchors with the same piece finds every
repeat, and one suffix in about ``(length - seed_bytes) / 2`` is enough.

A. Where texts are read: anchors with hashes of piece and of surroundings. Of equal surroundings in a batch only the
   earliest goes on; the others are covered. A piece with many different surroundings in one batch is marked hot.
B. By piece: of equal surroundings all but the earliest are covered. Pieces with several surroundings ask for their bytes.
C. Texts that are asked for cut out those surroundings.
D. By piece: the suffixes from the anchors on and the reversed prefixes before them are sorted by deep-shallow sorting.
   Cutting both arrays of common prefixes at depths that add up to ``length`` gives, for each offset, the classes of
   equal strings; all but the earliest member are covered. Strings around hot pieces are dealt out one by one instead, by
   their own hashes, so that no task gets all surroundings of a piece that a large part of the corpus shares.
E. Covered spans meet their text again, which gets its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, shuffle_partitions, stored, worker_cache
from .shingles import BASE, BYTE, U, mix, slices
from .suffixes import deep_shallow_sort

PIECE = 2 << 20  # bytes of text worked on at once
ANCHORS, SPANS, ASKED, WINDOWS = range(4)
BLOB = "kind int, part int, doc array<long>, h array<long>, pos array<int>, key array<long>, ctx array<long>, body binary"
LISTS = "kind int, doc_id long, h long, a array<int>, b array<int>"
MIX_KEY = U(0xD6E8FEB86659FD93)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the worker."""
    home = worker_cache("powers")
    if len(home.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", U(pow(int(BASE), -1, 2**64)))):
            p = np.full(n + 4096, base, dtype=U)
            p[0] = 1
            home[name] = np.multiply.accumulate(p)
    return home["up"][:n], home["down"][:n]


class Hashed:
    """Hashes of any slices of a byte string, from running sums."""

    def __init__(self, u: np.ndarray):
        up, self.down = powers(len(u) + 1)
        self.total = np.zeros(len(u) + 1, dtype=U)
        np.cumsum(BYTE[u] * up[:-1], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.down[starts]


def slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``w`` values in a row, by doubling."""
    size = 1
    while 2 * size <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def anchors(hashed: Hashed, n: int, window_ok: np.ndarray, length: int, seed_bytes: int) -> np.ndarray:
    """Places that hold the smallest piece of an allowed window (of ``length`` bytes, by its start)."""
    if n < length:
        return np.zeros(0, dtype=np.int64)
    h = (((hashed.total[seed_bytes:] - hashed.total[:-seed_bytes]) * hashed.down[: n + 1 - seed_bytes]) * MIX_KEY >> U(32)).astype(np.uint32)
    w = length - seed_bytes + 1
    low = slide(h, w, np.minimum)
    low[~window_ok[: len(low)]] = 0
    edge = np.zeros(w - 1, dtype=np.uint32)
    high = slide(np.concatenate([edge, low, edge]), w, np.maximum)
    return np.flatnonzero((high == h) & (high > 0))


def _earliest(keys: list[np.ndarray], doc: np.ndarray, h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys and then place in the corpus, and which of them is the first of its keys. Repeats of one place are dropped."""
    order = np.lexsort((pos, h, doc, *keys[::-1]))
    sorted_keys = [k[order] for k in keys]
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in sorted_keys:
        same &= k[1:] == k[:-1]
    again = same.copy()
    for k in (doc, h, pos):
        again &= k[order][1:] == k[order][:-1]
    keep = np.concatenate([[True], ~again])[: len(order)]
    first = np.concatenate([[True], ~same])[: len(order)]
    return order[keep], first[keep]


def _blob(kind: int, part: int, doc, h, pos, key=None, ctx=None, body: bytes | None = None) -> tuple:
    return kind, part, doc, h, pos, key, ctx, body


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    cols = list(zip(*rows, strict=True))
    out = []
    for c, t in zip(cols, kinds, strict=True):
        if pa.types.is_list(t):
            lens = [0 if x is None else len(x) for x in c]
            whole = [x.view(np.int64) if x.dtype == U else x for x in c if x is not None]  # as integers: mixed kinds would become floats
            values = np.concatenate([*whole, np.zeros(0, dtype=np.int64)])
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(values.astype(t.value_type.to_pandas_dtype()))))
        else:
            out.append(pa.array(c, t))
    return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in BLOB.split(", ")])


def _dealt(kind: int, parts: int, by: np.ndarray, doc, h, pos, key=None, ctx=None, body: np.ndarray | None = None) -> list[tuple]:
    """One blob for each part that ``by`` deals to."""
    part = (by % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ids, first = np.unique(part[order], return_index=True)
    rows = []
    for p, own in zip(ids.tolist(), np.split(order, first[1:]), strict=True):
        rows.append(_blob(kind, p, doc[own], h[own], pos[own], None if key is None else key[own], None if ctx is None else ctx[own], None if body is None else body[own].tobytes()))
    return rows


def _lists(kind: int, doc: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per document with its values as arrays. Spans (start, length) of a document that touch are joined."""
    if not len(doc):
        return
    order = np.lexsort((a, h, doc))
    doc, h, a, b = doc[order], h[order], a[order].astype(np.int64), b[order].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    if kind == SPANS:
        number = np.cumsum(new) - 1
        shift = number * (2**32)  # so that running maxima do not cross documents
        reach = np.maximum.accumulate(a + b + shift)
        start = new.copy()
        start[1:] |= (a + shift)[1:] > reach[:-1]
        last = np.append(np.flatnonzero(start)[1:], len(a)) - 1
        b = (reach[last] - (a + shift)[start])
        doc, h, a, new = doc[start], h[start], a[start], new[start]
    at = np.flatnonzero(new)
    ends = pa.array(np.append(at, len(a)), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), kind), pa.int32()), pa.array(doc[at]), pa.array(h[at]), pa.ListArray.from_arrays(ends, pa.array(a, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(b, pa.int32()))],
        names=[x.split()[0] for x in LISTS.split(", ")],
    )


def _scan(parts: int, length: int, seed_bytes: int, hot: int):
    """Step A."""
    margin = length + seed_bytes

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, int, int, int, int]]:
        """doc, h, bytes with margins, offset of the bytes in the text, length of the text, first and last window start in the bytes."""
        for doc, h, text in zip(batch["doc_id"].to_pylist(), batch["h"].to_pylist(), batch["text"], strict=True):
            raw = text.as_buffer()
            n = len(raw)
            for s in range(0, max(0, n - length + 1), PIECE):
                e = min(n - length + 1, s + PIECE)
                lo, hi = max(0, s - margin), min(n, e + length + margin)
                yield doc, h, raw[lo:hi].to_pybytes(), lo, n, s - lo, e - lo

    def work(group: list[tuple], turn: int) -> Iterator[pa.RecordBatch]:
        u = np.frombuffer(b"\0".join(g[2] for g in group), dtype=np.uint8)
        sizes = np.array([len(g[2]) for g in group])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        first, last = starts + [g[5] for g in group], starts + [g[6] for g in group]
        step = np.zeros(len(u) + 2, dtype=np.int8)
        step[first] += 1
        step[last] -= 1
        hashed = Hashed(u)
        at = anchors(hashed, len(u), np.cumsum(step)[: len(u)] > 0, length, seed_bytes)
        owner = np.searchsorted(starts, at, side="right") - 1
        column = lambda k: np.array([g[k] for g in group], dtype=np.int64)
        pos = at - starts[owner] + column(3)[owner]
        left = np.minimum(pos, length - seed_bytes)
        right = np.minimum(column(4)[owner] - pos, length)
        key = mix(hashed.of(at, at + seed_bytes))
        ctx = mix(mix(hashed.of(at - left, at + right)) ^ (left * 1024 + right).astype(U))
        doc, h = column(0)[owner], column(1)[owner]
        order, head = _earliest([key, ctx], doc, h, pos)
        again = order[~head]
        rows = []
        if len(again):
            ok = left[again] + right[again] >= length
            again = again[ok]
            for r in _lists(SPANS, doc[again], h[again], pos[again] - left[again], left[again] + right[again]):
                # a list row as a blob that step B hands on
                flat = [np.repeat(r[c].to_numpy(), np.diff(r["a"].offsets.to_numpy())) for c in ("doc_id", "h")]
                rows.append(_blob(SPANS, turn % parts, *flat, r["a"].values.to_numpy(), r["b"].values.to_numpy()))
        heads = order[head]
        k = key[heads]
        run = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(run, len(k)))
        is_hot = np.repeat(count >= hot, count)
        asked = heads[is_hot]
        if len(asked):
            rows.append(_blob(ASKED, turn % parts, doc[asked], h[asked], pos[asked]))
        mark = np.zeros(len(heads), dtype=bool)
        mark[run[count >= hot]] = True
        marked = np.zeros(len(at), dtype=U)
        marked[heads[mark]] = 1
        sent = np.sort(heads[~is_hot | mark])  # as in the texts, so that repeated ids compress
        # the lowest bit of the key says that the piece is hot
        sent_key = (key[sent] & ~U(1)) | marked[sent]
        rows += _dealt(ANCHORS, parts, key[sent] >> U(20), doc[sent], h[sent], pos[sent], sent_key, ctx[sent], np.stack([left[sent], right[sent]], axis=1).astype(np.uint8))
        if rows:
            yield _blobs(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            group = list(pieces(batch))
            for i, j in slices([g[2] for g in group], PIECE):
                yield from work(group[i:j], turn)
                turn += 1

    return scan


def _columns(rows: pa.Table, kind: int) -> tuple[list[np.ndarray], bytes]:
    own = rows.filter(pa.array(rows["kind"].to_numpy() == kind)).combine_chunks()
    flat = [own[c].combine_chunks().flatten().to_numpy() if own.num_rows else np.zeros(0, dtype=np.int64) for c in ("doc", "h", "pos", "key", "ctx")]
    return flat, b"".join(x for x in own["body"].to_pylist() if x)


def _match(length: int):
    """Step B."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ["part"]):
            (doc, h, start, size, _), _ = _columns(rows, SPANS)
            yield from _lists(SPANS, doc, h, start, size)
            (doc, h, pos, _, _), _ = _columns(rows, ASKED)
            yield from _lists(ASKED, doc, h, pos, np.ones(len(pos), dtype=np.int32))
            (doc, h, pos, key, ctx), body = _columns(rows, ANCHORS)
            if not len(doc):
                continue
            sides = np.frombuffer(body, dtype=np.uint8).reshape(-1, 2).astype(np.int64)
            key, ctx = key.view(U), ctx.view(U)
            marked, key = (key & U(1)).astype(bool), key >> U(1)
            order, head = _earliest([key, ctx], doc, h, pos)
            again = order[~head]
            again = again[sides[again].sum(axis=1) >= length]
            yield from _lists(SPANS, doc[again], h[again], pos[again] - sides[again, 0], sides[again].sum(axis=1))
            heads = order[head]
            k = key[heads]
            run = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            count = np.diff(np.append(run, len(k)))
            is_hot = np.zeros(len(k), dtype=bool)
            hot_keys = np.unique(key[marked])
            if len(hot_keys):
                is_hot = hot_keys[np.minimum(np.searchsorted(hot_keys, k), len(hot_keys) - 1)] == k
            several = np.repeat(count > 1, count) | is_hot
            asked = heads[several]
            yield from _lists(ASKED, doc[asked], h[asked], pos[asked], is_hot[several].astype(np.int32))

    return match


def _surroundings(parts: int, length: int, seed_bytes: int):
    """Step C: (doc_id, h, text, a, b) to surroundings by piece, and strings around hot pieces by their own hash."""
    reach = length - seed_bytes

    def work(group: list[tuple], turn: int) -> Iterator[pa.RecordBatch]:
        """group: doc, h, bytes, places, hot."""
        u = np.frombuffer(b"\0".join(g[2] for g in group) + bytes(length), dtype=np.uint8)
        sizes = np.array([len(g[2]) for g in group])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        counts = [len(g[3]) for g in group]
        owner = np.repeat(np.arange(len(group)), counts)
        pos = np.concatenate([g[3] for g in group]).astype(np.int64)
        is_hot = np.concatenate([g[4] for g in group]).astype(bool)
        doc, h = (np.array([g[k] for g in group], dtype=np.int64)[owner] for k in (0, 1))
        at, left, right = starts[owner] + pos, np.minimum(pos, reach), np.minimum(sizes[owner] - pos, length)
        hashed, rows = Hashed(u), []
        i = np.flatnonzero(~is_hot)
        if len(i):
            body = np.zeros((len(i), 2 + reach + length), dtype=np.uint8)
            body[:, 0], body[:, 1] = left[i], right[i]
            back, ahead = np.arange(1, reach + 1), np.arange(length)
            body[:, 2 : 2 + reach] = np.where(back <= left[i, None], u[np.maximum(at[i, None] - back, 0)], 0)
            body[:, 2 + reach :] = np.where(ahead < right[i, None], u[np.minimum(at[i, None] + ahead, len(u) - 1)], 0)
            key = mix(hashed.of(at[i], at[i] + seed_bytes))
            rows += _dealt(ANCHORS, parts, key >> U(20), doc[i], h[i], pos[i], key, None, body)
        i = np.flatnonzero(is_hot)
        for lo in range(0, len(i), 4096):
            j = i[lo : lo + 4096]
            offset = np.arange(reach + 1)
            ok = (offset <= left[j, None]) & (length - offset <= right[j, None])
            who, o = np.nonzero(ok)
            who = j[who]
            begin = at[who] - o
            one = mix(hashed.of(begin, begin + length))
            half = mix(hashed.of(begin + length // 2, begin + length) ^ MIX_KEY)
            order, head = _earliest([one, half], doc[who], h[who], pos[who] - o)
            again, heads = order[~head], order[head]
            for r in _lists(SPANS, doc[who][again], h[who][again], (pos[who] - o)[again], np.full(len(again), length)):
                flat = [np.repeat(r[c].to_numpy(), np.diff(r["a"].offsets.to_numpy())) for c in ("doc_id", "h")]
                rows.append(_blob(SPANS, turn % parts, *flat, r["a"].values.to_numpy(), r["b"].values.to_numpy()))
            rows += _dealt(WINDOWS, parts, one[heads] >> U(20), doc[who][heads], h[who][heads], (pos[who] - o)[heads], one[heads], half[heads])
        if rows:
            yield _blobs(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            group = []
            for doc, h, text, a, b in zip(batch["doc_id"].to_pylist(), batch["h"].to_pylist(), batch["text"], batch["a"], batch["b"], strict=True):
                raw, places = text.as_buffer(), a.values.to_numpy()
                first = np.unique(places, return_index=True)[1]
                group.append((doc, h, raw.to_pybytes(), places[first], b.values.to_numpy()[first]))
            for i, j in slices([g[2] for g in group], PIECE // 2):
                yield from work(group[i:j], turn)
                turn += 1

    return cut


def _sort(length: int, seed_bytes: int):
    """Step D."""
    reach = length - seed_bytes
    wide = lambda n: -(-n // 8) * 8

    def classes(prefix: np.ndarray, depth: int) -> np.ndarray:
        return np.cumsum(prefix < depth)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ["part"]):
            (doc, h, start, size, _), _ = _columns(rows, SPANS)
            yield from _lists(SPANS, doc, h, start, size)
            (doc, h, pos, one, half), _ = _columns(rows, WINDOWS)
            if len(doc):
                order, head = _earliest([one, half], doc, h, pos)
                again = order[~head]
                yield from _lists(SPANS, doc[again], h[again], pos[again], np.full(len(again), length))
            (doc, h, pos, key, _), body = _columns(rows, ANCHORS)
            if not len(doc):
                continue
            body = np.frombuffer(body, dtype=np.uint8).reshape(len(doc), -1)
            by = np.lexsort((pos, h, doc))  # from here on a smaller index is earlier in the corpus
            doc, h, pos, key, body = doc[by], h[by], pos[by], key[by], body[by]
            n = len(doc)
            left, right = body[:, 0].astype(np.int64), body[:, 1].astype(np.int64)
            before, after = np.zeros((n, wide(reach)), dtype=np.uint8), np.zeros((n, wide(length)), dtype=np.uint8)
            before[:, :reach], after[:, :length] = body[:, 2 : 2 + reach], body[:, 2 + reach :]
            order_b, prefix_b = deep_shallow_sort(before, left, key, 24)
            order_a, prefix_a = deep_shallow_sort(after, right, key, wide(seed_bytes) + 8)
            least, most = np.full(n, length), np.full(n, -1)
            class_a, class_b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            for o in range(reach + 1):
                class_a[order_a], class_b[order_b] = classes(prefix_a, length - o), classes(prefix_b, o)
                some = np.flatnonzero((left >= o) & (right >= length - o))
                both = class_a[some] * (n + 1) + class_b[some]
                by = np.argsort(both, kind="stable")
                again = some[by[1:][both[by][1:] == both[by][:-1]]]
                least[again] = np.minimum(least[again], o)
                most[again] = np.maximum(most[again], o)
            hit = np.flatnonzero(most >= 0)
            yield from _lists(SPANS, doc[hit], h[hit], pos[hit] - most[hit], most[hit] - least[hit] + length)

    return sort


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step E."""
    for batch in batches:
        sizes, removed, spans, digests, starts, ends = [], [], [], [], [], []
        for text, a, b in zip(batch["text"], batch["a"], batch["b"], strict=True):
            raw = text.as_buffer()
            kept, at, begin, stop = hashlib.sha256(), 0, [], []
            if a.is_valid:
                first, size = a.values.to_numpy(), b.values.to_numpy()
                order = np.argsort(first, kind="stable")
                for s, n in zip(first[order].tolist(), size[order].tolist(), strict=True):
                    if stop and s <= stop[-1]:
                        stop[-1] = max(stop[-1], s + n)
                    else:
                        begin.append(s)
                        stop.append(s + n)
            for s, e in zip(begin, stop, strict=True):
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            sizes.append(len(raw))
            removed.append(sum(stop) - sum(begin))
            spans.append(len(begin))
            digests.append(kept.hexdigest())
            starts.append(begin)
            ends.append(stop)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"],
        )


def suffix_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, seed_bytes: int = 50, hot: int = 16
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs as starts and ends (bytes).

    A byte goes when a string of ``length`` bytes that covers it also starts earlier: at a smaller doc_id, or earlier in
    the same text. A null text is empty; a null doc_id counts as the smallest. Rows that share a doc_id stand in the order
    of their text's hash, and repeated rows (equal doc_id and text) count as one document and get equal results. Texts
    shorter than ``length`` lose nothing. ``length`` is at most 127 + seed_bytes. ``hot``: different surroundings of a
    piece in one batch from which its strings are dealt out one by one; it does not change the result. Columns beside
    doc_id and text are ignored.
    """
    if not 8 <= seed_bytes < length or length > 255:
        raise ValueError("seed_bytes must be from 8 to below length, length at most 255")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    by_part = lambda df: df.repartition(parts, "part").sortWithinPartitions("part")
    found = stored(by_part(rows.mapInArrow(_scan(parts, length, seed_bytes, hot), BLOB)).mapInArrow(_match(length), LISTS), "suffix-matches")
    gathered = lambda df: df.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))
    asked = gathered(found.where(F.col("kind") == ASKED))
    once = rows.join(asked, ["doc_id", "h"]).select("doc_id", "h", "text", "a", "b")
    sorted_spans = by_part(once.mapInArrow(_surroundings(parts, length, seed_bytes), BLOB)).mapInArrow(_sort(length, seed_bytes), LISTS)
    spans = gathered(found.where(F.col("kind") == SPANS).unionByName(sorted_spans))
    low = F.col("doc_id") != -(2**63)
    done = rows.join(spans, ["doc_id", "h"], "left").select("doc_id", "text", "a", "b").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    )
    return done.withColumn("doc_id", F.when(low, F.col("doc_id")))
