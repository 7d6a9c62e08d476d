"""Operators 11, 12 and 13 against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import catalog
from offerlens.llm.common import table
from offerlens.llm.hard_negatives import Rows, mine_hard_negatives, threshold_scores
from offerlens.llm.licenses import license_scan, read_expression
from offerlens.llm.runs import batch_runs, lyndon_groups, periodic_runs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, words string, h long, g string, n int, a long, p long, row int, block string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, 4, 5, "z") for i, t in rows], DOCS)


# licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def plain_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places = [(k, label) for k in range(len(words)) for p, label in PHRASES.items() if tuple(words[k : k + len(p)]) == p]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    (1, None), (2, ""), (3, "MIT License"), (4, "the GNU General-Public\nLICENSE, mit license mit license"), (5, "mit licenseé émit license"), (5, "mit licenseé émit license"),
    (None, "Apache License apache license"), (6, "x " * 40_000 + "general public license" + " y" * 40_000), (7, "mitlicense MIT\x00LICENSE"), (8, "İMIT license KMIT License"),
    (9, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */ more"), (10, "SPDX-License-Identifier: MIT AND"),
    (11, "SPDX License Identifier MIT"), (12, "spdx-license-identifier:"), (13, "Released under the MIT license. SPDX-License-Identifier: MIT\nSPDX-License-Identifier: EUPL-1.2"),
]


def test_base_phrases_of_the_license_scan(spark):
    data = docs(spark, LICENSED).unionByName(table(spark, SF, "documents").select("doc_id", "text"), allowMissingColumns=True)
    got = sorted((tuple(r)[:6] for r in license_scan(data).collect()), key=str)
    assert got == sorted(((i, *plain_base(t)) for i, t in data.select("doc_id", "text").collect()), key=str)
    assert license_scan(data.limit(0)).count() == 0
    for r in license_scan(data).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_license_tags(spark):
    found = {r.doc_id: r for r in license_scan(docs(spark, LICENSED)).collect()}
    assert found[9].labels == "apache,gpl,mit" and found[9].score == 1.0 and found[9].openness == 0.5
    assert [tuple(e) for e in found[9].expressions] == [("(mit or apache-2.0) and gpl-2.0-only with classpath-exception-2.0", True, 0.5)]
    assert found[10].labels == "mit" and not found[10].expressions[0].valid and found[10].openness == 1.0 and found[10].score == 0.5
    assert found[11].labels == found[12].labels == "" and found[11].score == 0 and found[12].expressions == []
    assert found[13].labels == "mit,other" and found[13].openness == 0.0 and len(found[13].expressions) == 2
    assert [tuple(s) for s in found[3].spans] == [(0, 2, "mit")]


def plain_openness(tokens):
    """Recursive descent over the same grammar."""
    values = {"mit": 1.0, "gpl-2.0": 0.2, "lgpl-3.0": 0.5, "cc-by-nc-4.0": 0.0, "cc-by-4.0": 0.9}

    def unit(k):
        if tokens[k] == "(":
            v, k = either(k + 1)
            assert tokens[k] == ")"
            return v, k + 1
        v, k = values[tokens[k]], k + 1
        if k < len(tokens) and tokens[k] == "with":
            v, k = (0.5 if 0 < v < 0.5 else v), k + 2
        return v, k

    def both(k):
        v, k = unit(k)
        while k < len(tokens) and tokens[k] == "and":
            w, k = unit(k + 1)
            v = min(v, w)
        return v, k

    def either(k):
        v, k = both(k)
        while k < len(tokens) and tokens[k] == "or":
            w, k = both(k + 1)
            v = max(v, w)
        return v, k

    return either(0)[0]


def test_expressions_against_recursive_descent():
    draw = random.Random(3)

    def made(depth):
        if depth == 0 or draw.random() < 0.3:
            x = draw.choice(["mit", "gpl-2.0", "lgpl-3.0", "cc-by-nc-4.0", "cc-by-4.0"])
            return [x, "with", "some-exception"] if draw.random() < 0.2 else [x]
        x = [*made(depth - 1), draw.choice(["and", "or"]), *made(depth - 1)]
        return ["(", *x, ")"] if draw.random() < 0.5 else x

    for _ in range(500):
        tokens = made(4)
        _, valid, openness, _ = read_expression(" ".join(tokens).encode())
        assert valid and openness == plain_openness(tokens)
    for line in ("mit or", "(mit", "and mit", "mit and or gpl-2.0", "()", "(mit or gpl-2.0) with x", "mit with (x)"):
        assert not read_expression(line.encode())[1]
    assert read_expression(b"mit this file is")[0] == "mit" and read_expression(b" mit) x")[0] == "mit"


# periodic runs


def plain_runs(words, least_periods=4, least_words=6):
    found, n = set(), len(words)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            own = words[start : start + length]
            smallest = not any(own[p:] == own[:-p] for p in range(1, q))
            if length >= max(least_words, least_periods * q) and smallest:
                found.add((start, length, q))
    return found


def test_lyndon_groups():
    draw = random.Random(1)
    for _ in range(300):
        w = [draw.randint(1, 3) for _ in range(draw.randint(1, 14))]
        longest = [max(k for k in range(1, len(w) - i + 1) if all(w[i : i + k] < w[j : i + k] for j in range(i + 1, i + k))) for i in range(len(w))]
        lyndon, group = lyndon_groups(np.array(w))
        assert lyndon.tolist() == longest
        named = collections.defaultdict(set)
        for i, (k, g) in enumerate(zip(longest, group.tolist(), strict=True)):
            named[g].add(tuple(w[i : i + k]))
        assert all(len(x) == 1 for x in named.values()) and len(set.union(*named.values())) == len(named)


def test_runs_against_all_periods():
    draw = random.Random(2)
    for _ in range(600):
        n, letters = draw.randint(0, 60), draw.choice([1, 2, 3, 6])
        w = [draw.randint(1, letters) for _ in range(n)]
        if n > 10 and draw.random() < 0.7:
            s, p = draw.randrange(n), draw.randint(1, 5)
            for i in range(s + p, n):
                w[i] = w[i - p]
        k, m = draw.choice([2, 3, 4]), draw.choice([1, 6])
        two = np.array([*w, *w[:n]], dtype=np.int64)  # two texts, the runs of which do not join
        got = batch_runs(np.repeat([0, 1], n), two, np.array([0, n]), k, m)
        assert set(got.get(0, [])) == set(got.get(1, [])) == plain_runs(w, k, m)


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))


def test_periodic_runs_query(spark, tmp_path):
    odd = [
        (None, "a a a a a a a"), (1, None), (2, ""), (3, "a " * 30_000), (3, "a " * 30_000), (4, "a b a b a b a b x y z y z y z y z"), (5, " \t\n"), (6, "a a a a a"),
        (7, "é\x00 é\x00 é\x00 é\x00 é\x00 é\x00"), (8, "a b " * 6), *((i, " ".join(random.Random(i).choices("abcde", k=i % 200))) for i in range(100, 400)),
    ]
    docs(spark, odd).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    plain = [plain_digest(i, t) if i != 3 else None for i, t in odd]
    long = ("a " * 30_000).split()
    h = zlib.crc32(b"3")
    assert h % 10  # the long one repeats nothing more
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    plain = [p or (3, 1, 0, len(long), 1, 1000 * len(long), digest(f"0,{len(long)},1\n"), digest("a")) for p in plain]
    assert sorted(got, key=str) == sorted(plain, key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in odd if i)
    empty = periodic_runs(spark.createDataFrame([], "doc_id long, words array<string>"))
    assert empty.count() == 0
    assert tuple(periodic_runs(spark.createDataFrame([(None, None)], "doc_id long, words array<string>")).first()) == (None, 0, [], None, "")


def test_periodic_runs_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    short = {i: t for i, t in rows if len(t or "") < 4_000}
    got = {r.doc_id: tuple(r) for r in catalog.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == plain_digest(i, t) for i, t in short.items()) and sum(got[i][1] for i in short) > 5


# hard negatives

VECTORS = "vec_id long, label int, vector array<long>, row string, block int, anchor_row long, slot int, kind int, score long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, "x", 1, 2, 3, 4, 5) for i, y, v in rows], VECTORS)


def plain_negatives(rows, is_anchor, positives=5, negatives=5, percent=80):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, y, v) in enumerate(rows):
        if not is_anchor(i):
            continue
        key = lambda r: (-r[1], r[0] is None, r[0] or 0)
        scored = [(j, dot(v, w), z == y, m == k) for m, (j, z, w) in enumerate(rows)]
        for p in sorted((s for s in scored if s[2] and not s[3]), key=key)[:positives]:
            some = sorted((s for s in scored if not s[2] and percent * p[1] <= 100 * s[1] <= 100 * p[1]), key=key)[:negatives]
            out += [(i, p[0], rank, s[0], p[1], s[1]) for rank, s in enumerate(some, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [8192, 256])
def test_hard_negatives_against_all_pairs(spark, block_rows):
    draw = random.Random(5)
    centres = [[draw.randint(-40, 60) for _ in range(20)] for _ in range(6)]
    rows = [(i, draw.choice([0, 0, 0, 1, 2, 3]), [x + draw.randint(-60, 60) for x in draw.choice(centres)]) for i in range(900)]
    rows += [(900 + i, i % 3, centres[0]) for i in range(60)]  # ties
    rows += [(None, 1, centres[0]), (None, 2, centres[1]), (1000, None, centres[0]), (1001, 1, None), (1002, 1, [1, None]), (1010, 7, [5] * 20), (1020, 8, []), (1030, 8, [3, 4])]
    rows += [(10, 1, centres[2]), (10, 1, centres[2]), (20, 0, [0] * 20)]  # repeated ids and rows
    is_anchor = lambda i: i is not None and i % 10 == 0
    data = vectors(spark, rows)
    got = mine_hard_negatives(data, anchor=F.col("vec_id") % 10 == 0, block_rows=block_rows, anchor_rows=32)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows, is_anchor)


def test_hard_negatives_of_odd_tables(spark):
    anchor = F.col("vec_id") % 10 == 0
    assert mine_hard_negatives(vectors(spark, []), anchor=anchor).count() == 0
    assert mine_hard_negatives(vectors(spark, [(1, 1, [1]), (2, 2, [2])]), anchor=anchor).count() == 0
    far = [(10, 1, [2**40, 1]), (11, 1, [2**20, 7]), (12, 2, [2**20, 6]), (13, 2, [2**20, 8])]
    got = mine_hard_negatives(vectors(spark, far), anchor=anchor)
    assert [tuple(r) for r in got.collect()] == [(10, 11, 1, 12, 2**60 + 7, 2**60 + 6)]


def test_threshold_scores_lose_no_row():
    draw = np.random.default_rng(4)
    for _ in range(30):
        x, q = draw.integers(-50, 50, (300, 21)) * draw.integers(0, 2, (300, 1)), draw.integers(-50, 50, (10, 21))
        as_rows = lambda v: Rows({"numbers": np.arange(len(v)).tobytes(), "ids": np.zeros((len(v), 2), np.int64).tobytes(), "labels": np.zeros(len(v), np.int64).tobytes(), "vectors": v.astype("<i8").tobytes(), "windows": np.zeros(len(v), np.int64).tobytes()}, 21, "<i8")
        lowest = draw.choice([-np.inf, -1000.0, 2000.0, 8000.0], 10)
        if draw.random() < 0.7:
            lowest = np.maximum(lowest, 2000.0)
        at, score = threshold_scores(as_rows(q), as_rows(x), lowest, draw.permutation(21))
        exact = q @ x.T
        assert (score == exact[:, at]).all()
        assert not (np.delete(exact, at, axis=1) >= lowest[:, None]).any()
