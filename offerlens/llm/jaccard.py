"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Where texts are read, each becomes its set of word n-grams (64-bit hashes), a hash of that set, and band hashes of its
   MinHash signature. Bands and rows are the cheapest that find a pair at the threshold with the target recall.
2. Documents with the same set form one class; only classes go on, so copies never meet in pairs.
3. Band hashes are shuffled. A bucket gives star edges to its smallest class, never pairs; connected components of the
   stars are the candidate clusters.
4. The sets of clustered classes are recomputed once and compared within their cluster in blocks of bounded size: a large
   cluster is cut into blocks, and each pair of blocks is a task. Pairs are counted, not emitted; a block pair returns
   each class's number of links and one spanning edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, stored
from .components import components
from .shingles import U, distinct_grams, gram_hashes, mix, slices, word_hashes

NULL_ID = -(2**63)
BLOCK_GRAMS, BLOCK_SETS = 1_000_000, 384  # of one side of a block pair


def choose_bands(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """Bands and rows: the largest number of rows (fewest false candidates) that reaches ``recall`` within ``most_hashes``."""
    best = (1, 1)
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= recall else -int(-(log(1 - recall) / log(1 - hit)) // 1)
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def set_hashes(grams: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One hash of each set of distinct grams; 0 for empty sets."""
    counts = np.diff(before)
    some = counts > 0
    nodes = np.zeros(len(counts), dtype=U)
    if some.any():
        nodes[some] = mix(np.add.reduceat(mix(grams ^ U(0x5851F42D4C957F2D)), before[:-1][some]) ^ mix(counts[some].astype(U)))
    return nodes


def _signatures(n: int, bands: int, rows: int, seed: int):
    random = np.random.default_rng(seed)
    a = random.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = random.integers(0, 2**32, bands * rows, dtype=np.uint32)
    salt = random.integers(0, 2**64, bands, dtype=U)

    def of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, before, _, _ = word_hashes(texts)
        grams, before = distinct_grams(*gram_hashes(words, before, n))
        counts = np.diff(before)
        some = counts > 0
        nodes, sig = set_hashes(grams, before), np.zeros((len(texts), bands), dtype=U)
        if some.any():
            at = before[:-1][some]
            low = (grams >> U(32)).astype(np.uint32)
            hashed = np.empty_like(low)
            for k in range(bands):
                h = np.full(len(at), salt[k], dtype=U)
                for r in range(k * rows, (k + 1) * rows):
                    np.multiply(low, a[r], out=hashed)
                    hashed += b[r]
                    h = mix(h ^ np.minimum.reduceat(hashed, at).astype(U))
                sig[some, k] = h
        return nodes, counts, sig

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch["text"]]
            for i, j in slices(texts):
                nodes, counts, sig = of(texts[i:j])
                some = counts > 0
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]), pa.int32()), pa.array(sig[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(nodes.view(np.int64), mask=~some), pa.array(counts, pa.int64()), sets],
                    names=["doc_id", "node", "n_grams", "bands"],
                )

    return sign


def _sets(n: int):
    """The text's distinct n-grams beside the class's columns; rows that only share the doc_id of the class's row go."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch["text"]]
            for i, j in slices(texts):
                words, before, _, _ = word_hashes(texts[i:j])
                grams, before = distinct_grams(*gram_hashes(words, before, n))
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(grams.view(np.int64)))
                part = pa.RecordBatch.from_arrays(
                    [batch[c].slice(i, j - i) for c in ("cluster", "node", "copies", "parts")] + [lists], names=["cluster", "node", "copies", "parts", "grams"]
                )
                yield part.filter(pa.array(set_hashes(grams, before).view(np.int64) == part["node"].to_numpy()))

    return sets


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Number of common elements of each pair of sets, by products of 0/1 matrices over blocks of elements."""
    n = len(sets)
    if n == 2:
        both = np.concatenate(sets)
        both.sort()
        c = int((both[1:] == both[:-1]).sum())
        return np.array([[len(sets[0]), c], [c, len(sets[1])]], dtype=np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
    uses = np.bincount(column)
    keep = uses[column] > 1
    column, owner = (np.cumsum(uses > 1) - 1)[column[keep]], owner[keep]
    total = np.zeros((n, n), dtype=np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        block = np.zeros((n, width), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - k * width] = 1
        total += block @ block.T
    total = total.astype(np.int64)
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reached from each index by the symmetric matrix ``linked``."""
    n = len(linked)
    root = np.arange(n)
    while True:
        best = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1))
        best = best[best]
        if (best == root).all():
            return root
        root = best


def _verify(threshold: Fraction):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in grouped(batches, ["cluster", "i", "j"]):
            nodes = rows["node"].to_numpy()
            nodes, first = np.unique(nodes, return_index=True)  # a document read twice is one
            rows = rows.take(pa.array(first))
            if len(nodes) < 2:
                continue
            sets = [g.values.to_numpy() for g in rows["grams"]]
            sizes = np.array([len(s) for s in sets])
            common = shared_counts(sets)
            union = sizes[:, None] + sizes[None, :] - common
            linked = common * threshold.denominator >= union * threshold.numerator
            np.fill_diagonal(linked, False)
            if i != j:
                block = rows["block"].to_numpy()
                linked &= block[:, None] != block[None, :]
            links = linked @ rows["copies"].to_numpy()
            root = nodes[_roots(linked)]
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[some]), pa.array(links[some], pa.int64()), pa.array(root[some]), pa.array(np.full(some.sum(), i != j or bool(rows["parts"][0].as_py() > 1)))],
                names=["node", "links", "root", "split"],
            )

    return verify


def jaccard_join(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999,
    block_grams: int = BLOCK_GRAMS, block_sets: int = BLOCK_SETS, seed: int = 3,
) -> DataFrame:
    """Per row: doc_id, class_id, n_links, rep_id, n_grams.

    Two documents are linked when the Jaccard similarity of their sets of ``n``-word runs is ``threshold`` or more. n_links
    counts the linked other rows, copies included. class_id is the smallest doc_id of those reached over links, rep_id the
    smallest doc_id with the same set. A text of 1 to n-1 words is one run of all its words; a null or empty text has no
    set, no links and its own class. Repeated rows are copies of each other. A null doc_id counts as the smallest and
    stays null. A pair at the threshold is found with probability ``recall`` at least (more similar ones more surely);
    what is found is verified exactly but for collisions of 64-bit hashes. Other columns are ignored.
    """
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signatures(n, bands, rows, seed), "doc_id long, node long, n_grams long, bands array<long>"), "jaccard-signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams"), F.max("bands").alias("bands")
    )
    nodes = stored(nodes, "jaccard-classes")
    bucketed = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    low = bucketed.groupBy("band", "value").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = bucketed.join(low, ["band", "value"]).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    clusters = components(stars).withColumnRenamed("component", "cluster")
    members = nodes.select("node", "rep", "copies", "n_grams").join(clusters, "node")
    sizes = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.sum("n_grams") / block_grams), F.ceil(F.count(F.lit(1)) / block_sets)
    ).cast("int").alias("parts"))
    members = stored(members.join(sizes, "cluster").select(F.col("rep").alias("doc_id"), "node", "copies", "cluster", "parts"), "jaccard-members")
    # always by a shuffle of both sides: a plan that only small inputs get would say nothing about large ones
    sets = texts.join(members.hint("merge"), "doc_id").mapInArrow(_sets(n), "cluster long, node long, copies long, parts int, grams array<long>")
    block = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")).cast("int")
    dealt = sets.withColumn("block", block).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    checked = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(
        _verify(Fraction(str(threshold))), "node long, links long, root long, split boolean"
    )
    checked = stored(checked, "jaccard-links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("split").alias("split"))
    spread = checked.where("split").select(F.col("node").alias("a"), F.col("root").alias("b"))
    joined = components(spread).withColumnRenamed("component", "wide") if spread.take(1) else links.select("node", F.col("root").alias("wide")).limit(0)
    linked = nodes.select("node", "rep", "copies").join(links, "node", "left").join(joined, "node", "left").select(
        "node", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("wide", "root", "node").alias("component"),
    )
    linked = stored(linked, "jaccard-components")
    label = linked.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = linked.join(label, "component").select("node", "rep", "n_links", "class_id")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return (
        signed.drop("bands").join(named, "node", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("rep", "doc_id").alias("rep_id"), "n_grams")
        .select(real("doc_id"), real("class_id"), "n_links", real("rep_id"), "n_grams")
    )
