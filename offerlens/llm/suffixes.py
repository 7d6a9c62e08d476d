"""Sorting of suffixes, cut at a fixed depth, by deep-shallow sorting.

Shallow: multikey sorting, eight bytes at a time, of all groups at once; what is alone in its group is done. Deep: each
group that still shares its first ``shallow`` bytes is ordered by a blind trie, which looks at one byte for each branch
and compares a whole suffix once.
"""

from __future__ import annotations

import numpy as np


class BlindTrie:
    """Compressed trie over integers of ``bits`` bits; inner nodes are [bit, left, right], leaves lists of numbers."""

    def __init__(self, bits: int):
        self.bits, self.root = bits, None
        self.keys: list[int] = []

    def insert(self, key: int) -> None:
        number = len(self.keys)
        self.keys.append(key)
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly down, by the branching bits only
            node = node[1][(key >> node[0]) & 1]
        differ = (self.keys[node[0]] ^ key).bit_length() - 1
        if differ < 0:
            node.append(number)
            return
        holder, side, node = None, 0, self.root
        while isinstance(node, tuple) and node[0] > differ:
            holder, side = node, (key >> node[0]) & 1
            node = node[1][side]
        pair = [node, [number]] if (key >> differ) & 1 else [[number], node]
        fresh = (differ, pair)
        if holder is None:
            self.root = fresh
        else:
            holder[1][side] = fresh

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][1], node[1][0]]
            else:
                out += node
        return out


def deep_shallow_sort(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` (zero-padded bytes, a multiple of eight wide) within their groups, and common prefix with the one before.

    The prefix is at most the shorter length, and -1 at the first of a group. Equal rows stand in order of length.
    """
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort((lengths, group))
    head = np.ones(n, dtype=bool)
    head[1:] = group[order][1:] != group[order][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    place = rank.copy()
    place[order] = np.arange(n)
    active = order[~(head & np.append(head[1:], True))]
    for depth in range(0, min(shallow, width), 8):
        if not len(active):
            break
        key = words[active, depth // 8]
        by = np.lexsort((lengths[active], key, rank[active]))
        active, key = active[by], key[by]
        old = rank[active]
        first = np.ones(len(active), dtype=bool)
        first[1:] = old[1:] != old[:-1]
        fresh = first.copy()
        fresh[1:] |= key[1:] != key[:-1]
        at = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(first, at, 0))
        place[active] = old + at - begin
        rank[active] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - begin
        active = active[~(fresh & np.append(fresh[1:], True))]
    if len(active):
        starts = np.flatnonzero(np.concatenate([[True], rank[active][1:] != rank[active][:-1]])).tolist()
        tail = np.ascontiguousarray(rows[active, min(shallow, width) :])
        size = tail.shape[1]
        raw = tail.tobytes()
        for a, z in zip(starts, [*starts[1:], len(active)], strict=True):
            if not size:
                continue
            members = active[a:z]
            if z - a == 2:
                swap = raw[a * size : (a + 1) * size] > raw[(a + 1) * size : (a + 2) * size]
                by = [1, 0] if swap else [0, 1]
            else:
                trie = BlindTrie(8 * size)
                for i in range(a, z):
                    trie.insert(int.from_bytes(raw[i * size : (i + 1) * size], "big"))
                by = trie.order()
            place[members[by]] = rank[members[0]] + np.arange(z - a)
    order = np.empty(n, dtype=np.int64)
    order[place] = np.arange(n)
    prefix = np.full(n, -1, dtype=np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        same = group[a] == group[b]
        for lo in range(0, n - 1, 65536):
            hi = min(n - 1, lo + 65536)
            differ = rows[a[lo:hi]] != rows[b[lo:hi]]
            lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            prefix[lo + 1 : hi + 1] = np.where(same[lo:hi], np.minimum(lcp, np.minimum(lengths[a[lo:hi]], lengths[b[lo:hi]])), -1)
    return order, prefix
