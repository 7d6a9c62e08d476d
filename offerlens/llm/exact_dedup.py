"""Exact deduplication over an extendible-hash index on shared files.

1. Every text gets a 64-bit key. Keys are counted with map-side combining, so a text that a third of all rows share
   moves as one row per task.
2. Owner tasks each process a range of keys. An owner inserts its keys into an extendible-hash directory: a full bucket
   is split by its next bit, and the directory doubles when that bucket's depth is the directory's. The buckets, with
   the bytes of one document of each key that occurs twice or more, are written to the shared folder.
3. Every row looks its key up in the index and compares bytes. Rows that differ from the bytes of their key form the
   collision chain: they pass through the same steps again under the next seed, until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

INDEX = "owner int, bucket int, depth int, key long, n long, head long, head_text string"


class Directory:
    """Extendible hashing over unsigned 64-bit keys whose first ``skip`` bits are the owner's."""

    def __init__(self, capacity: int, skip: int):
        self.capacity, self.skip, self.depth = capacity, skip, 0
        self.slots = np.zeros(1, dtype=np.int64)  # bucket of each value of the next ``depth`` bits
        self.buckets: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)]
        self.depths = [0]

    def _bits(self, keys: np.ndarray, depth: int) -> np.ndarray:
        if not depth:
            return np.zeros(len(keys), dtype=np.int64)
        return ((keys << np.uint64(self.skip)) >> np.uint64(64 - depth)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        at = self.slots[self._bits(keys, self.depth)]
        order = np.argsort(at, kind="stable")
        ids, first = np.unique(at[order], return_index=True)
        for b, part in zip(ids.tolist(), np.split(keys[order], first[1:]), strict=True):
            self.buckets[b] = np.concatenate([self.buckets[b], part])
            full = [b]
            while full:
                if len(self.buckets[x := full.pop()]) > self.capacity and self.depths[x] < 64 - self.skip:
                    full += [x, self._split(x)]

    def _split(self, b: int) -> int:
        """Split bucket ``b`` by its next bit; the new bucket gets the keys that have it set."""
        if self.depths[b] == self.depth:
            self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
        self.depths[b] += 1
        new, keys = len(self.buckets), self.buckets[b]
        up = (self._bits(keys, self.depths[b]) & 1).astype(bool)
        self.buckets[b] = keys[~up]
        self.buckets.append(keys[up])
        self.depths.append(self.depths[b])
        own = np.flatnonzero(self.slots == b)
        self.slots[own[(own >> (self.depth - self.depths[b])) & 1 == 1]] = new
        return new

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self.slots[self._bits(keys, self.depth)]


def _own(capacity: int, skip: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One directory for each key range of this task; entries of a range arrive in order of the range."""

        def done(owner: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Directory(capacity, skip)
            for p in parts:
                index.insert(p["key"].to_numpy().view(np.uint64))
            for p in parts:
                b = index.find(p["key"].to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [p["owner"], pa.array(b.astype(np.int32)), pa.array(np.array(index.depths, dtype=np.int32)[b]), p["key"], p["n"], p["head"]],
                    names=["owner", "bucket", "depth", "key", "n", "head"],
                )

        owner, parts = None, []
        for batch in batches:
            owners = batch["owner"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if owner is not None and owners[a] != owner:
                    yield from done(owner, parts)
                    parts = []
                owner = owners[a]
                parts.append(batch.slice(a, z - a))
        if parts:
            yield from done(owner, parts)

    return build


def build_index(rows: DataFrame, capacity: int, name: str) -> DataFrame:
    """Index of ``rows`` (doc_id, key, text): a row per key with its count, its largest doc_id and, if n > 1, that row's text."""
    spark = rows.sparkSession
    bits = max(1, (shuffle_partitions(spark) - 1).bit_length())
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("head"))
    entries = counts.withColumn("owner", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    owned = (
        entries.repartition(shuffle_partitions(spark), "owner")
        .sortWithinPartitions("owner")
        .select("owner", "key", "n", "head")
        .mapInArrow(_own(capacity, bits), "owner int, bucket int, depth int, key long, n long, head long")
    )
    index = stored(owned, f"{name}-buckets")
    repeated = index.where("n > 1").select("key", F.col("head").alias("doc_id"))
    heads = rows.join(repeated, ["key", "doc_id"]).groupBy("key").agg(F.max("text").alias("head_text"))
    return stored(index.join(heads, "key", "left").select(*[c.split()[0] for c in INDEX.split(", ")]), f"{name}-index")


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, key_bits: int = 64, seed: int = 42
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical byte for byte; null counts as empty. The row with the largest doc_id of a
    group stays; of repeated rows of that doc_id one stays. A null doc_id counts as the smallest: its row stays only if
    its group has no other, and keep_id is null then. An empty table gives an empty result. Other columns are ignored.
    ``key_bits`` below 64 makes keys collide (for tests). Memory of an owner task: the keys of its range.
    """
    low = -(2**63)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    found = _dedup(rows, capacity, key_bits, seed, 0)
    per_row = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    real = lambda c: F.when(F.col(c) != low, F.col(c)).alias(c)
    return per_row.select(
        real("doc_id"), real("keep_id"), "group_size", ((F.col("doc_id") == F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def _dedup(rows: DataFrame, capacity: int, key_bits: int, seed: int, turn: int) -> DataFrame:
    key = F.xxhash64(F.lit(seed + turn), "text")
    if key_bits < 64:
        key = F.shiftleft(F.pmod(key, F.lit(2**key_bits)), 64 - key_bits)
    keyed = rows.withColumn("key", key)
    index = build_index(keyed, capacity, f"dedup{turn}")
    looked = keyed.join(index.select("key", "n", "head", "head_text"), "key").select(
        "doc_id", "key", "n", F.col("head").alias("keep_id"), F.sha2("text", 256).alias("text_sha256"),
        ((F.col("n") == 1) | (F.col("text") == F.col("head_text"))).alias("same"),
    )
    looked = stored(looked, f"dedup{turn}-rows")
    same = looked.where("same").groupBy("doc_id", "key", "n", "keep_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    other = looked.where("not same")
    if not other.take(1):
        return same.select("doc_id", "keep_id", F.col("n").alias("group_size"), "text_sha256", "copies")
    # the collision chain: rows whose bytes differ from those of their key's document
    less = other.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    same = same.join(less, "key", "left").select(
        "doc_id", "keep_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("group_size"), "text_sha256", "copies"
    )
    chain = keyed.withColumn("text_sha256", F.sha2("text", 256)).join(
        other.select("doc_id", "key", "text_sha256").distinct(), ["doc_id", "key", "text_sha256"], "left_semi"
    )
    return same.unionByName(_dedup(stored(chain.select("doc_id", "text"), f"dedup{turn}-chain"), capacity, key_bits, seed, turn + 1))
