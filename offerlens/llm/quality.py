"""Quality rules from suffix arrays of words.

Texts of a batch share one numpy suffix array: words are ranked within their text, ranks are refined by prefix doubling,
and only suffixes that are still tied go into the next round. Common prefixes of neighbours come from the ranks of the
rounds. A suffix's longest common prefix with a neighbour is the longest repeat that starts there; the union of these
spans over all suffixes is the union of the spans of all maximal repeated substrings (the intervals of the array).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import SPACE, slices, word_hashes

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30

COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_words long, longest_repeat long, spans array<struct<start:int,end:int>>"
)
_symbol = np.zeros(256, dtype=bool)
_symbol[list(SYMBOLS)] = True


def longest_repeats(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each position the number of words from there on that also stand elsewhere in the same text."""
    n = len(words)
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    end = before[1:][owner]
    order = np.lexsort((words, owner))
    first = np.ones(n, dtype=bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group's rank is its first place
    levels, h = [rank], 1
    active = order[~(first & np.append(first[1:], True))]
    while len(active):
        following = active + h
        key = np.where(following < end[active], rank[np.minimum(following, n - 1)], -1)
        by = np.lexsort((key, rank[active]))
        active, key = active[by], key[by]
        old = rank[active]
        group = np.ones(len(active), dtype=bool)
        group[1:] = old[1:] != old[:-1]
        fresh = group.copy()
        fresh[1:] |= key[1:] != key[:-1]
        place = np.arange(len(active))
        start = np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - start
        levels.append(rank)
        active, h = active[~(fresh & np.append(fresh[1:], True))], 2 * h
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    some = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[some].copy(), b[some].copy()
    lcp = np.zeros(len(some), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end[suffixes[:-1][some]]) & (b < end[suffixes[1:][some]])
        same = np.zeros(len(a), dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        lcp += same * (1 << k)
        a, b = a + same * (1 << k), b + same * (1 << k)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, suffixes[:-1][some], lcp)
    np.maximum.at(longest, suffixes[1:][some], lcp)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a span; spans may overlap."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def _measure(min_repeat: int, max_fraction: float, max_longest: int):
    def of(texts: list[bytes]) -> list[np.ndarray | pa.Array]:
        words, before, _, _ = word_hashes(texts)
        n, counts = len(words), np.diff(before)
        u = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)[ends - 1]]))
        chars, symbols = per_text(~SPACE[u] & ((u & 0xC0) != 0x80)), per_text(_symbol[u])
        dup = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\v\f\r")]
            dup[i] = len(lines) - len(set(lines))
        repeat, cover, longest = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        spans, span_counts = np.zeros((0, 2), dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        if n:
            m = longest_repeats(words, before)
            per_word = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[before])
            at = np.flatnonzero(m >= WINDOW)
            repeat = per_word(covered(at, np.full(len(at), WINDOW), n))
            at = np.flatnonzero(m >= min_repeat)
            mask = covered(at, m[at], n)
            cover = per_word(mask)
            some = counts > 0
            longest[some] = np.maximum.reduceat(np.where(m >= min_repeat, m, 0), before[:-1][some])
            owner = np.repeat(np.arange(len(texts)), counts)
            edge = np.zeros(n, dtype=bool)
            edge[before[:-1][some]] = True
            begin = np.flatnonzero(mask & (edge | ~np.concatenate([[False], mask[:-1]])))
            stop = np.flatnonzero(mask & np.append(edge[1:] | ~mask[1:], True)) + 1
            spans = np.stack([begin - before[owner[begin]], stop - before[owner[begin]]], axis=1).astype(np.int32)
            span_counts = np.bincount(owner[begin], minlength=len(texts))
        failed = (counts < LEAST_WORDS) | (100 * repeat > REPEAT_PERCENT * counts)
        kept = ~failed & (cover <= max_fraction * counts) & (longest <= max_longest)
        structs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(span_counts)]), pa.int32()), structs)
        return [*(pa.array(x, pa.int64()) for x in (counts, chars, symbols, dup, repeat)), pa.array(failed), pa.array(kept), pa.array(cover, pa.int64()), pa.array(longest, pa.int64()), lists]

    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch["text"]]
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), *of(texts[i:j])], names=names)

    return measure


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 4, max_fraction: float = 0.5, max_longest: int = 64
) -> DataFrame:
    """Per row: counts, base_failed, kept, covered_words, longest_repeat and spans (words that lie in repeats).

    ``min_repeat``: words of a repeated substring that counts (the base rules count windows of eight). Kept: the base rules hold, repeats cover at most
    ``max_fraction`` of the words and none is longer than ``max_longest``. A null or empty text has no words and fails the
    base rules. Every row is judged by itself, so repeated rows get equal results; a null doc_id stays null. Words are
    compared by 64-bit hashes. Memory of a task: one batch, or one text if that is longer. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_measure(min_repeat, max_fraction, max_longest), COLUMNS)
