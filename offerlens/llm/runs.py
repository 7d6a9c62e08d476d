"""Periodic runs of words by Baier's grouping.

Phase one of Baier's suffix sorter groups suffixes by the longest Lyndon word that starts at them, so its groups are a
Lyndon array: equal groups are equal words. It runs once under the order of the word codes and once under the reversed
order; by the runs theorem every run has a Lyndon root that is a longest Lyndon word under one of the two. Roots that follow
one another are chained by their groups, and a chain is extended to both sides by common extensions (LCE) of the places
one period apart.

A run of at least ``k`` periods holds each of its words ``k`` times, so words that occur fewer times in a stretch cut it,
again and again, before the grouping: they lie in no run that counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = tuple[int, int, int]

SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
    "strongest struct<start:long,length:long,period:long>, collapsed string"
)
#: Words of a batch that are grouped at once; a longer stretch is alone.
AT_ONCE = 1 << 16


def lyndon_groups(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and group of the longest Lyndon word from each place on; places of equal groups start with equal words.

    ``text`` holds codes of 1 and above, and 0 between stretches: a Lyndon word never passes a 0. Groups are intervals of
    the suffix array, treated from the greatest to the smallest. A group's members pass their word on to the place
    before them whose word ends there, as often as members follow one another; such places move to the upper
    end of their group as a group of their own.
    """
    n = len(text)
    array = np.argsort(text, kind="stable")
    first = np.flatnonzero(np.diff(text[array], prepend=-1))
    sizes = np.diff(np.append(first, n))
    place = np.empty(n, dtype=np.int64)
    place[array] = np.arange(n)
    start = np.empty(n, dtype=np.int64)
    start[array] = np.repeat(first, sizes)
    separators = int((text == 0).sum())
    array, place, start = array.tolist(), place.tolist(), start.tolist()
    size, length = dict(zip(first.tolist(), sizes.tolist(), strict=True)), dict.fromkeys(first.tolist(), 1)
    before = list(range(-1, n - 1))
    lyndon = [1] * n
    end = n
    while end > separators:
        group = start[array[end - 1]]
        words = length[group]
        follow: dict[int, int] = {}
        final: dict[int, int] = {}
        for at in sorted(array[group:end]):
            lyndon[at] = words
            p = before[at]
            while p >= 0 and start[p] > group:
                p = before[p]
            if p >= 0 and start[p] == group:
                p = final[p]
            final[at] = before[at] = p
            if p >= 0 and text[p]:
                follow[p] = follow.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, times in follow.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for p in by_times[times]:
                old = start[p]
                size[old] -= 1
                moved[old] = moved.get(old, 0) + 1
                there, here = old + size[old], place[p]
                other = array[there]
                array[here], place[other] = other, here
                array[there], place[p] = p, there
            for old, count in moved.items():
                new = old + size[old]
                length[new] = length[old] + times * words
                size[new] = count
                for p in array[new : new + count]:
                    start[p] = new
        end = group
    return np.array(lyndon, dtype=np.int64), np.array(start, dtype=np.int64)


def common_extension(text: np.ndarray, a: int, b: int, step: int) -> int:
    """Number of equal places from ``a`` and ``b`` (a < b) on, forwards (step 1) or backwards (step -1); 0 ends it."""
    total, width, n = 0, 32, len(text)
    while True:
        most = min(width, n - b if step > 0 else a + 1)
        if most <= 0:
            return total
        x, y = (text[a : a + most], text[b : b + most]) if step > 0 else (text[a - most + 1 : a + 1][::-1], text[b - most + 1 : b + 1][::-1])
        differ = (x != y) | (x == 0)
        if differ.any():
            return total + int(differ.argmax())
        total, a, b, width = total + most, a + step * most, b + step * most, 2 * width


def runs_of(text: np.ndarray, least_periods: int, least_words: int) -> set[Run]:
    """All runs (start, length, period) of ``text`` (codes, 0 between stretches) that are long enough."""
    found: set[Run] = set()
    if not len(text):
        return found
    n, reversed_order = len(text), np.where(text > 0, text.max() + 1 - text, 0)
    for order in (text, reversed_order):
        lyndon, group = lyndon_groups(order)
        at = np.arange(n)
        following = at + lyndon
        linked = (following < n) & (order > 0)
        linked[linked] = group[following[linked]] == group[at[linked]]
        previous = at - lyndon
        inner = previous >= 0
        inner[inner] = linked[previous[inner]] & (group[previous[inner]] == group[at[inner]])
        for head in np.flatnonzero((linked if least_periods > 2 else order > 0) & ~inner).tolist():
            period, last = int(lyndon[head]), head
            while linked[last]:
                last += period
            if (last - head) // period + 1 < least_periods - 1:
                continue  # a run of k periods holds k - 1 whole roots at least
            right = last + period
            right += common_extension(text, last, right, 1)
            left = head - common_extension(text, head - 1, head + period - 1, -1)
            if right - left >= max(least_words, least_periods * period):
                found.add((left, right - left, period))
    return found


def crowded(owner: np.ndarray, codes: np.ndarray, least: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places left, and the stretch each lies in, once words that occur fewer than ``least`` times in their stretch are cuts.

    Stretches of fewer than ``least_words`` words go, and cuts are repeated until nothing changes.
    """
    places, stretch = np.arange(len(codes)), owner
    while len(places):
        by = np.lexsort((codes[places], stretch))
        s, c = stretch[by], codes[places][by]
        new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])]))
        counts = np.diff(np.append(new, len(s)))
        often = np.empty(len(s), dtype=bool)
        often[by] = np.repeat(counts >= least, counts)
        kept, parent = places[often], stretch[often]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(kept) != 1) | (parent[1:] != parent[:-1])])[: len(kept)])
        sizes = np.diff(np.append(new, len(kept)))
        long = np.repeat(sizes >= least_words, sizes)
        left, number = kept[long], np.repeat(np.arange(len(sizes)), sizes)[long]
        if len(left) == len(places):
            return left, number
        places, stretch = left, number
    return places, stretch


def batch_runs(owner: np.ndarray, codes: np.ndarray, first: np.ndarray, least_periods: int, least_words: int) -> dict[int, list[Run]]:
    """Runs of each text of a batch, by start and period; ``first`` is the place of a text's first word."""
    places, stretch = crowded(owner, codes, least_periods, least_words)
    found: dict[int, list[Run]] = {}
    if not len(places):
        return found
    cuts = np.append(np.flatnonzero(np.diff(stretch, prepend=-1)), len(places)).tolist()
    a = 0
    while a < len(cuts) - 1:
        z = a + 1
        while z < len(cuts) - 1 and cuts[z + 1] - cuts[a] <= AT_ONCE:
            z += 1
        own = places[cuts[a] : cuts[z]]
        gaps = np.searchsorted(np.array(cuts[a + 1 : z]) - cuts[a], np.arange(len(own)), side="right")
        at = np.arange(len(own)) + gaps  # one 0 between stretches
        text, back = np.zeros(len(own) + z - a - 1, dtype=np.int64), np.zeros(len(own) + z - a - 1, dtype=np.int64)
        text[at], back[at] = np.unique(codes[own], return_inverse=True)[1] + 1, own
        for start, length, period in runs_of(text, least_periods, least_words):
            place = int(back[start])
            doc = int(owner[place])
            found.setdefault(doc, []).append((place - int(first[doc]), length, period))
        a = z
    return {doc: sorted(runs, key=lambda r: (r[0], r[2])) for doc, runs in found.items()}


def strongest(runs: list[Run]) -> Run:
    """The run with the greatest length / period, compared exactly; ties by start, then period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def _detect(least_periods: int, least_words: int):
    def of(ids: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        codes = pc.fill_null(flat.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        found = batch_runs(np.repeat(np.arange(len(counts)), counts), codes, first, least_periods, least_words)
        text = pc.fill_null(pc.binary_join(words, " "), "").to_pylist()
        runs: list[list[dict]] = [[] for _ in text]
        best: list[dict | None] = [None] * len(text)
        for doc, own in found.items():
            as_dict = lambda r: {"start": r[0], "length": r[1], "period": r[2]}
            runs[doc], best[doc] = [as_dict(r) for r in own], as_dict(strongest(own))
            keep = pa.array(~dropped(int(counts[doc]), own))
            text[doc] = " ".join(flat.slice(int(first[doc]), int(counts[doc])).filter(keep).to_pylist())
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        columns = [ids, pa.array(counts), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield of(batch["doc_id"], batch["words"])

    return detect


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", words_col: str = "words", least_periods: int = 4, least_words: int = 6
) -> DataFrame:
    """Per row: its number of words, all runs by start and period, the strongest run, and its words without repeats.

    ``words_col`` is an array of strings. A run is a stretch with smallest period q of at least ``least_periods`` (2 or more)
    times q and ``least_words`` words that cannot be extended. The strongest run has the greatest exact length / period; ties
    go to the smallest start, then period; it is null without a run. ``collapsed`` joins by one space the words that lie in no
    run after its first q words. A null or empty array has no words and no runs, and ``collapsed`` is empty. Every row is
    judged by itself, so repeated rows get equal results and a null id stays null; an empty table gives an empty one;
    other columns are ignored. Words are compared by themselves, not by hashes. Nothing is shuffled; memory of a task is one
    Arrow batch, or one text if that is longer.
    """
    if least_periods < 2:
        raise ValueError("a run has at least two periods")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(words_col).cast("array<string>").alias("words"))
    return rows.mapInArrow(_detect(least_periods, least_words), SCHEMA)


def with_planted_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and words of each text; words repeat from a place on where the id's checksum is divisible by ten.

    With h the crc32 of the decimal id, g = h / 10, n words, a = g % n and p = 1 + (n - a) / (3 + g % 8) (whole divisions), word i >= a is
    word a + (i - a) % p. A null text has no words; a null id repeats nothing.
    """
    from .common import WORD

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)).alias("words"),
        F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h"),
    )
    rows = rows.withColumns({"g": F.expr("h div 10"), "n": F.size("words").cast("long")})
    rows = rows.withColumn("a", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = "transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))])"
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("words")).otherwise(F.expr(repeated)).alias("words"))
