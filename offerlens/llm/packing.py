"""First-fit-decreasing packing, run independently in randomised groups.

Every document is tokenised where it is read and cut into pieces of at most one sequence; only piece descriptions (no
ids) are shuffled. Pieces are dealt to groups by a seeded hash of document and start, so a document of any length and
any hot key spread evenly, and a group holds about ``group_pieces`` pieces at every input size. In a group, pieces in
falling order of length go to the first bin with room, found by a tournament tree of the bins' capacities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_worker_caches, stored
from .tokens import token_bytes

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ``lengths`` must be in falling order, none above ``capacity``.

    The tree's leaves are the bins' free room and an inner node holds the larger of its children, so the first bin with
    room is found by going left wherever the left child has enough.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i, need in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= need
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


def _cut(tokenizer: str, seq_len: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(tokenizer)
        for batch in batches:
            ids, starts, lengths, crcs, totals = [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = encode(text.as_py() or "") + b"\0\0\0\0"
                total = len(raw) // 4
                for start in range(0, total, seq_len):
                    piece = raw[4 * start : 4 * (start + seq_len)]
                    ids.append(doc_id)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (ids, starts, lengths, crcs, totals)], names=[x.split()[0] for x in PIECES.split(", ")])

    return cut


def _fill(seq_len: int):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        drop_worker_caches()  # all texts are tokenised by now
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), seq_len)
        return pdf.assign(sequence_id=pdf["grp"] * 2**32 + bins, offset=offsets).drop(columns="grp")

    return fill


def pack_documents(
    docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 1024, group_pieces: int = 40_000, seed: int = 11
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then id 0; a null or empty text is that id alone. Documents longer than ``seq_len`` are cut
    at its multiples, the rest of each is packed whole. Repeated rows are packed as often as they come; a null doc_id
    stays null. An empty table gives no pieces. Other columns are ignored. Memory of a task: one batch of texts, or one
    group of about ``group_pieces`` pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(_cut(tokenizer, seq_len), PIECES), "pack-pieces")
    groups = max(1, round(pieces.count() / group_pieces))
    # the place of a row in its stored file tells rows with one id, or none, apart
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(_fill(seq_len), f"{PIECES}, sequence_id long, offset long")
