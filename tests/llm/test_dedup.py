"""Operators 1, 4, 6 and 7 against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from offerlens.llm.components import components
from offerlens.llm.exact_dedup import Directory, exact_dedup
from offerlens.llm.jaccard import choose_bands, jaccard_join
from offerlens.llm.passage_dedup import compact_windows, passage_dedup, verified
from offerlens.llm.suffix_dedup import suffix_dedup
from offerlens.llm.suffixes import deep_shallow_sort

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, part int, node long, size double"


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(n))


def corpus(seed=0):
    """Ids and texts: copies, near copies, shared passages, empty and null texts, ties, a long text."""
    r = random.Random(seed)
    passage, line = words(r, 70), words(r, 30)
    texts = [words(r, r.randint(1, 120)) for _ in range(30)]
    texts += [words(r, 20) + " " + passage + " " + words(r, 20) for _ in range(12)]
    for t in texts[:6]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[5], "", "", None, None, " \n\t ", "x", "a" * 400, "ab" * 300, line + "\n" + line, words(r, 9000) + " " + passage]
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0, 1, "k", 2, 3, 0.5) for i, t in rows], SCHEMA)


def plain_spans(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        step = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                step[p] += 1
                step[p + length] -= 1
            seen.add(b[p : p + length])
        gone = np.cumsum(step[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone]) if b else b""
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2, 16, 10**6])
def test_suffix_dedup_equals_plain_version(spark, hot):
    rows = corpus()
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup(frame(spark, rows), hot=hot).collect()}
    assert got == plain_spans(rows)


def test_suffix_dedup_of_repeated_rows_null_ids_and_no_rows(spark):
    r = random.Random(1)
    long = words(r, 60)
    rows = [(1, long), (1, long), (None, long), (2, long)]
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_removed) for x in suffix_dedup(frame(spark, rows)).collect())
    n = len(long.encode())
    assert got == [(False, 0, 0), (True, 1, n), (True, 1, n), (True, 2, n)]
    assert suffix_dedup(frame(spark, [])).collect() == []


def test_deep_shallow_sort():
    r = np.random.default_rng(3)
    rows = r.integers(0, 2, (300, 24)).astype(np.uint8)
    rows[100:200, :20] = 7
    lengths = r.integers(1, 25, 300)
    for i, n in enumerate(lengths):
        rows[i, n:] = 0
    group = r.integers(0, 3, 300)
    for shallow in (0, 8, 16, 24):
        order, prefix = deep_shallow_sort(rows, lengths, group, shallow)
        key = [(group[i], rows[i].tobytes(), lengths[i]) for i in order]
        assert key == sorted(key)
        for k in range(1, 300):
            a, b = order[k - 1], order[k]
            same = next((x for x in range(24) if rows[a, x] != rows[b, x]), 24)
            assert prefix[k] == (-1 if group[a] != group[b] else min(same, lengths[a], lengths[b]))


def grams(t, n=5):
    w = WORD.findall(t or "")
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("block_sets", [2, 384])
def test_jaccard_join_equals_plain_version(spark, block_sets):
    rows = corpus(2)
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(frame(spark, rows), block_sets=block_sets).collect()}
    assert got == {i: (top(i), links[i]) for i in sets}
    assert jaccard_join(frame(spark, [])).collect() == []


def test_jaccard_join_of_repeated_rows_and_shared_ids(spark):
    r = random.Random(4)
    a, b = words(r, 40), words(r, 40)
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_links) for x in jaccard_join(frame(spark, [(1, a), (1, a), (1, b), (2, b), (None, None)])).collect())
    assert got == [(False, 0, 0), (True, 1, 1), (True, 1, 1), (True, 1, 1), (True, 2, 1)]


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (5, 6), (7, 7), (6, 9), (4, 10), (10, 11)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 11: 1, 5: 5, 6: 5, 9: 5}


def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree():
    h = np.random.default_rng(5).integers(1, 50, 200).astype(np.uint32)
    first, last = np.repeat([0, 120], [120, 80]), np.repeat([120, 200], [120, 80])
    want = []
    for c in range(200):
        lo = c
        while lo > first[c] and h[lo - 1] > h[c]:
            lo -= 1
        hi = c
        while hi + 1 < last[c] and h[hi + 1] >= h[c]:
            hi += 1
        if hi - lo + 1 >= 7:
            want.append((c, c - lo, hi - c))
    assert list(zip(*(x.tolist() for x in compact_windows(h, first, last, 7)), strict=True)) == want


def test_passages_are_found_and_are_what_they_say(spark):
    rows = corpus(6)
    got = passage_dedup(frame(spark, rows)).collect()
    text = {i: WORD.findall(t or "") for i, t in rows}
    cover = collections.defaultdict(set)
    for r in got:
        cover[r.doc_id].update(range(r.start, r.end))
        a, b = grams(" ".join(text[r.doc_id][r.start : r.end])), grams(" ".join(text[r.source_doc_id][r.source_start : r.source_end]))
        assert r.end - r.start >= 50 and r.source_doc_id < r.doc_id and r.similarity == pytest.approx(len(a & b) / len(a | b)) and r.similarity >= 0.8
    seen = {}
    for i in sorted(text):
        runs = [tuple(text[i][k : k + 50]) for k in range(len(text[i]) - 49)]
        for k, run in enumerate(runs):
            if seen.get(run, i) != i:
                assert {k, k + 49} <= cover[i]
        for run in runs:
            seen.setdefault(run, i)
    assert passage_dedup(frame(spark, [])).collect() == []
    assert passage_dedup(frame(spark, [(None, None), (1, ""), (2, "a b c")])).collect() == []


def test_verification_finds_every_edit_that_the_threshold_allows():
    r = np.random.default_rng(4)
    text = lambda k: r.integers(0, 10**9, k).tolist()
    hashed = lambda t: np.array([hash(tuple(t[i : i + 5])) for i in range(len(t) - 4)])

    def sure(own, other):
        found = verified(own, other, 46, 0.8)
        for a, z, b, y, similarity in found:
            x, w = set(own[a:z].tolist()), set(other[b:y].tolist())
            assert z - a >= 46 and y - b >= 46 and similarity == len(x & w) / len(x | w) >= 0.8
        return bool(found)

    for size in range(50, 81):
        for at in range(size):
            p = text(size)
            for q in (p[:at] + text(1) + p[at + 1 :], p[:at] + text(1) + p[at:], p[:at] + p[at + 1 :]):
                x, w = set(hashed(p).tolist()), set(hashed(q).tolist())
                if len(q) >= 50 and len(x & w) / len(x | w) >= 0.8:
                    assert sure(hashed(text(20) + p + text(25)), hashed(text(30) + q + text(20))), (size, at)
    # passages that stand together in one text and apart in the other
    one, two = text(60), text(70)
    assert len(verified(hashed(one + two), hashed(one + text(300) + two), 46, 0.8)) == 2
    assert not sure(hashed(text(300)), hashed(text(300)))
    # 15 of 20 grams match, so no run is similar enough
    p = text(4000)
    assert not sure(hashed(p), hashed([-i if i % 20 == 0 else w for i, w in enumerate(p)]))


@pytest.mark.parametrize("key_bits", [2, 64])
def test_exact_dedup_equals_plain_version(spark, key_bits):
    rows = corpus(7) + [(500, "twice"), (500, "twice"), (None, "twice"), (None, "alone")]
    got = collections.Counter(tuple(r) for r in exact_dedup(frame(spark, rows), key_bits=key_bits, capacity=3).collect())
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        for k, i in enumerate(sorted(ids, key=lambda x: x != keep)):
            want[i, keep, len(ids), k == 0, sha] += 1
    assert got == want
    assert exact_dedup(frame(spark, [])).collect() == []


def test_directory_doubles_and_finds_every_key():
    keys = np.random.default_rng(8).integers(0, 2**64, 5000, dtype=np.uint64) >> np.uint64(3)
    keys[:2000] >>= np.uint64(3)  # crowded: one side of the directory splits deeper
    index = Directory(capacity=16, skip=2)
    for part in np.split(keys, 10):
        index.insert(part)
    at = index.find(keys)
    assert all(k in index.buckets[b] for k, b in zip(keys[::50], at[::50], strict=True))
    assert max(map(len, index.buckets)) <= 16 and len(index.slots) == 2**index.depth and max(index.depths) == index.depth
    assert sum(map(len, index.buckets)) == 5000
