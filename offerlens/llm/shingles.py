"""Word and n-gram hashes of batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20_240_101)
BYTE = _random.integers(0, 2**64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
STEP = _random.integers(0, 2**64, 64, dtype=U) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: list[bytes], size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is alone."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, words before each text (one more than texts), and each word's start and end byte in its text."""
    u = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    if not len(u):
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[u]])))
    starts, ends = edge[::2], edge[1::2]
    power = np.full(len(u) + 1, BASE, dtype=U)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(len(u) + 1, dtype=U)
    np.cumsum(BYTE[u] * power[:-1], out=total[1:])
    # what is left of the powers, BASE ** len(u), must not depend on the batch
    hashes = mix((total[ends] - total[starts]) * power[len(u) - starts] * U(pow(int(power[len(u)]), -1, 2**64)))
    before = np.searchsorted(starts, offsets)
    own = np.repeat(offsets[:-1], np.diff(before))
    return hashes, before, starts - own, ends - own


def gram_hashes(words: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and grams before each text; a text of 1 to n-1 words is one gram."""
    counts = np.diff(before)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    gram_before = np.concatenate([[0], np.cumsum(grams)])
    first = np.repeat(before[:-1] - gram_before[:-1], grams) + np.arange(gram_before[-1])
    out = np.zeros(len(first), dtype=U)
    left = np.repeat(before[1:], grams)
    for j in range(n):
        at = first + j
        inside = at < left
        out += np.where(inside, words[np.minimum(at, len(words) - 1)] * STEP[j], U(0)) if len(words) else U(0)
    return mix(out), gram_before


def distinct_grams(grams: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of each text sorted and without repeats."""
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[new], minlength=len(before) - 1)
    return grams[new], np.concatenate([[0], np.cumsum(counts)])
