import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.operators import (
    anomaly, dedup, distribution, history, iforest, lof, projection, rules, sampling, segments, stats,
)
from offerlens.operators.stats import _exact_u_pvalue


def test_crawl_dedup_equals_scan(spark):
    rng = random.Random(5)
    rows = [(i, f"l{rng.randint(0, 25)}", f"Title {rng.randint(0, 25)}") for i in range(150)]
    links, names, kept = set(), set(), []
    for i, link, title in rows:
        name = "".join(c for c in title.lower() if c.isalnum())
        if link in links or name in names:
            continue
        links.add(link)
        names.add(name)
        kept.append(i)
    df = spark.createDataFrame(rows, "id int, link string, title string")
    assert sorted(r["id"] for r in dedup.crawl_dedup(df, ["id"]).collect()) == kept


def test_crawl_dedup_runs_and_its_check(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), rng.choice([None, *map(str, range(9))]), f"T {rng.randint(0, 9)}") for i in range(80)]
    links, names, kept = set(), set(), []
    for i, shop, link, title in rows:
        if (shop, link) not in links and (shop, title) not in names:
            links.add((shop, link))
            names.add((shop, title))
            kept.append(i)
    df = spark.createDataFrame(rows, "id int, shop string, link string, title string")
    got = dedup.crawl_dedup(df, ["id"], ("shop",))
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == kept
    assert tuple(dedup.crawl_dedup_check(df, ["id"], ("shop",)).first()) == (80, 0, 0, 0)


def test_keep_first_with_missing_and_hot_links(spark):
    rows = [(i, None if i % 3 == 0 else ("N/A" if i % 3 == 1 else f"l{i}"), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, link string, price double")
    got = {r["link"]: r["id"] for r in dedup.dedup_links(df).collect()}
    assert len(got) == 102 and got[None] == 297 and got["N/A"] == 298


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.round(np.concatenate([rng.lognormal(8, 1, 500), np.full(300, 77.77), -rng.random(50), [0.0]]), 2)
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    got = distribution.quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.925}).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.925]), rel=1e-12)


def test_constant_histogram(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "price double")
    assert [r["count"] for r in distribution.histogram(df, "price", 3).orderBy("bin").collect()] == [0, 3, 0]


def test_mann_whitney(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(10, 3, 40), 0), np.round(rng.normal(11, 3, 60), 0)
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b], "price double, is_gaming boolean")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    both = np.concatenate([a, b])
    ties = sum(t**3 - t for t in np.unique(both, return_counts=True)[1])
    s = math.sqrt(40 * 60 / 12 * (101 - ties / (100 * 99)))
    p = math.erfc((max(u, 2400 - u) - 1200 - 0.5) / s / math.sqrt(2))
    got = stats.mann_whitney(df).first()
    assert got["statistic"] == pytest.approx(u) and got["pvalue"] == pytest.approx(p, abs=1e-6)
    assert _exact_u_pvalue(5, 5, 0) == pytest.approx(2 / 252)


def test_spearman(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 8, 200).astype(float), rng.integers(0, 8, 200).astype(float) 
    y = y + x
    rows = [(float(a), float(b) if i % 7 else None) for i, (a, b) in enumerate(zip(x, y))]
    got = stats.spearman_pairs(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).first()
    import pandas as pd
    pdf = pd.DataFrame(rows).dropna().rank()
    assert got["rho"] == pytest.approx(np.corrcoef(pdf[0], pdf[1])[0, 1]) and got["n"] == len(pdf)


def test_spearman_over_missing_values(spark, monkeypatch):
    r = random.Random(4)
    rows = [tuple(r.choice([None, -1.0, 0.0, 0.5, 2.0, 7.0]) for _ in range(3)) + (float(i) if i % 5 else None, None) for i in range(300)]
    names = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    pdf = df.toPandas()
    for short in (0, 50_000):  # ranks by a shuffle, and sent to all tasks
        monkeypatch.setattr(stats, "SHORT_SIDE", short)
        got = {(x.a, x.b): (x.rho, x.n) for x in stats.spearman_pairs(df, names).collect()}
        assert set(got) == set(combinations("abcd", 2))
        for (a, b), (rho, n) in got.items():
            both = pdf[[a, b]].dropna().rank()
            assert n == len(both) and abs(rho - both[a].corr(both[b])) < 1e-9



def test_silhouette_and_davies_bouldin(spark):
    rng = np.random.default_rng(4)
    v = np.round(np.concatenate([rng.normal(m, 1, 30) for m in (0, 6, 15)] + [[40.0]]), 1)
    lab = np.digitize(v, [3, 10, 30])
    scores = []
    for i in range(len(v)):
        own = [abs(v[i] - v[j]) for j in range(len(v)) if lab[j] == lab[i] and j != i]
        if not own:
            scores.append(0.0)
            continue
        b = min(np.mean(np.abs(v[i] - v[lab == c])) for c in set(lab) if c != lab[i])
        scores.append((b - np.mean(own)) / max(b, np.mean(own)))
    cs = {c: v[lab == c].mean() for c in set(lab)}
    sp = {c: np.abs(v[lab == c] - cs[c]).mean() for c in cs}
    db = np.mean([max((sp[i] + sp[j]) / abs(cs[i] - cs[j]) for j in cs if j != i) for i in cs])
    df = spark.createDataFrame([(int(c), float(x)) for c, x in zip(lab, v)], "cluster_id int, x double")
    counts = segments.cluster_counts(df, "x")
    assert segments.silhouettes(counts, []).first()[0] == pytest.approx(np.mean(scores))
    assert segments.davies_bouldin(counts, []).first()[0] == pytest.approx(db)


def test_kmeans_names_follow_price(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(m, m * 0.02, 60) for m in (1000, 5000, 20000)])
    df = spark.createDataFrame([(float(x), float(np.log10(x))) for x in p], "price double, log_price double")
    got = segments.kmeans_segments(df, 3, restarts=3).groupBy("cluster").agg(F.min("price").alias("a"), F.count("*").alias("n"))
    rows = {r["cluster"]: (r["a"], r["n"]) for r in got.collect()}
    assert [rows[n][1] for n in ("Entrée de gamme", "Milieu de gamme bas", "Milieu de gamme")] == [60, 60, 60]
    assert rows["Entrée de gamme"][0] < rows["Milieu de gamme bas"][0] < rows["Milieu de gamme"][0]


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    kd = dist[:, -1]
    lrd = 1 / (np.maximum(kd[near], dist).mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


@pytest.mark.parametrize("profiles", [1, 6])
def test_lof_equals_brute_force(spark, profiles):
    rng = np.random.default_rng(6)
    n, k = 160, 16
    a = rng.normal(4, 0.5, n)
    b = rng.integers(0, profiles, n).astype(float) ** 2
    c = rng.integers(0, max(1, profiles // 2), n).astype(float)
    rows = [(i, float(x), float(y), float(z), 1.0) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "id int, log_price double, ram_gb double, storage_gb double, price double")
    got = {r["id"]: r["anomaly_lof_score"] for r in lof.detect_lof(df).collect()}

    def scale(v):
        q = np.quantile(v, [0.25, 0.5, 0.75])
        return (v - q[1]) / ((q[2] - q[0]) or 1.0)

    want = brute_lof(np.stack([scale(a), scale(b), scale(c)], 1), k)
    assert np.allclose([got[i] for i in range(n)], want, atol=2e-4)


def test_lof_counts_copies(spark):
    rows = [(1.0, 8.0)] * 120 + [(2.0, 8.0)] * 3 + [(9.0, 16.0)]
    df = spark.createDataFrame([(a, b, a) for a, b in rows], "log_price double, ram_gb double, price double")
    got = lof.detect_lof(df, contamination=0.02)
    assert {r["price"] for r in got.where("anomaly_lof").collect()} <= {2.0, 9.0}
    assert got.count() == 124


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(v), 8.0) for i, v in enumerate(rng.normal(4, 0.1, 300))] + [(1000, 9.0, 128.0), (1001, 0.1, 2.0)]
    df = spark.createDataFrame(rows, "id int, log_price double, ram_gb double")
    got = iforest.detect_isolation_forest(df, trees=100)
    flagged = {r["id"] for r in got.where("anomaly_iforest").collect()}
    assert {1000, 1001} <= flagged and 10 <= len(flagged) <= 17
    worst = got.orderBy("anomaly_iforest_score").limit(2).collect()
    assert {r["id"] for r in worst} == {1000, 1001}


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2)) @ np.array([[3.0, 1.0], [0.5, 1.0]])
    df = spark.createDataFrame([(float(a), float(b), "t", "c", 1.0, "b") for a, b in x],
                               "log_price double, ram_gb double, title string, cluster string, price double, brand_detected string")
    got = sorted(abs(r["x"]) for r in projection.pca_scatter(df).collect())
    _, _, vt = np.linalg.svd(x - x.mean(0))
    assert np.allclose(got, sorted(np.abs((x - x.mean(0)) @ vt[0])), atol=1e-3)


def test_rules_from_every_split(spark):
    rows = [("a", "x", "p")] * 40 + [("b", "y", "q")] * 60 + [("a", "y", "q")] * 10
    df = spark.createDataFrame(rows, "brand_detected string, price_category string, cluster string")
    got = {(r["antecedent"], r["consequent"]): r for r in rules.laptop_rules(df).collect()}
    both = got[("cluster=p, price_category=x", "brand_detected=a")]
    assert both["confidence"] == 1.0 and both["lift"] == pytest.approx(110 / 50, abs=1e-4)
    assert ("cluster=p", "brand_detected=a, price_category=x") in got


def test_upsert_and_drops(spark):
    schema = "seq int, link string, title string, price double, date_scraped string, source string"
    base = spark.createDataFrame([(1, "a", "A", 100.0, "d1", "s"), (2, None, "N", 5.0, "d1", "s")], schema)
    batch = spark.createDataFrame([(3, "a", "A2", 75.0, "d2", "s"), (4, "b", "B", 9.0, "d2", "s"), (5, None, "N", 5.0, "d2", "s"),
                                   (6, "a", "A3", 0.0, "d3", "s")], schema)
    got = {(r["link"], r["title"], r["price"], r["date_scraped"]) for r in history.upsert_offers(base, batch, ["seq"]).collect()}
    assert got == {("a", "A", 0.0, "d3"), ("b", "B", 9.0, "d2"), (None, "N", 5.0, "d1"), (None, "N", 5.0, "d2")}
    alerts = history.price_drops(batch, base.where("link is not null")).collect()
    assert [(r["diff"], r["percentage"], r["currency"]) for r in alerts] == [(25.0, 25.0, "EUR")]


def test_iqr_missing_price_and_lists(spark):
    rows = [(float(v), "c") for v in [10, 11, 12, 13, 14, 500]] + [(None, "c")]
    df = spark.createDataFrame(rows, "price double, cluster string").withColumn("title", F.lit("t"))
    got = {r["price"]: (r["anomaly_iqr"], r["anomaly_iqr_type"]) for r in anomaly.detect_iqr(df).collect()}
    assert got[None] == (True, "normal") and got[500.0] == (True, "trop_haut") and got[10.0] == (False, "normal")


def test_every_nth_and_sample(spark):
    df = spark.range(2500).select("id", F.col("id").cast("string").alias("link"))
    assert [r["id"] for r in sampling.every_nth(df, 500, ["id"]).orderBy("id").limit(3).collect()] == [0, 5, 10]
    texts = df.select(F.format_string("%05d", "id").alias("key"))
    assert [r["key"] for r in sampling.every_nth(texts, 500, ["key"]).orderBy("key").limit(3).collect()] == ["00000", "00005", "00010"]
    one = [r["id"] for r in sampling.hash_sample(df, 50, ["id"]).collect()]
    assert one == [r["id"] for r in sampling.hash_sample(df.repartition(7), 50, ["id"]).collect()] and len(set(one)) == 50


def test_crawl_dedup_with_missing_leads_writes_little(spark):
    import os
    from offerlens.operators import dedup
    rows = [(None if i % 50 == 0 else i % 977, None if i % 31 == 0 else f"https://shop.example/item/{i * 7919 % 9000}", f"Title {i % 40} of a long name", f"r{i % 3}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, link string, title string, source string").distinct()
    folder = spark.sparkContext.getCheckpointDir()
    size = lambda: sum(os.path.getsize(os.path.join(a, f)) for a, _, fs in os.walk(folder.removeprefix("file:")) for f in fs) if folder else 0
    order, run = ["id", "link", "title", "source"], ("source",)
    low = lambda v: (v is not None, v if v is not None else 0)
    expected, links, names = set(), set(), set()
    for r in sorted(df.collect(), key=lambda r: (low(r.id), (r.link is not None, r.link or ""), r.title, r.source)):
        link, name = (r.source, r.link), (r.source, r.title)
        if link not in links and name not in names:
            expected.add(r)
            links.add(link)
            names.add(name)
    before = size()
    got = dedup.crawl_dedup(df, order, run).collect()
    assert set(got) == expected and len(got) == len(expected)
    folder = spark.sparkContext.getCheckpointDir()
    assert size() - before < 2_000_000


def counted(spark, rows, schema):
    """A table whose rows are counted each time that they are read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return spark.createDataFrame(rows, schema).mapInPandas(count, schema), seen


def test_group_stats_reads_rows_once(spark):
    rows = [("a" if i % 3 else "b", float(i % 17)) for i in range(200)] + [("c", 0.1), ("c", 0.1), ("c", 0.1), (None, 1.0), ("a", None)]
    df, seen = counted(spark, rows, "brand string, price double")
    got = {r.brand: r for r in stats.stats_by_brand(df).collect()}
    assert seen.value == len(rows)
    for key in "ab":
        x = np.array([p for b, p in rows if b == key and p is not None])
        assert got[key]["count"] == len(x)
        found = [got[key][c] for c in ("mean", "std", "median", "p25", "min", "max")]
        assert found == pytest.approx([x.mean(), x.std(ddof=1), np.median(x), np.quantile(x, 0.25), x.min(), x.max()], abs=0.006)
    assert (got["c"]["mean"], got["c"]["std"], set(got)) == (0.1, 0.0, {"a", "b", "c"})


def test_quantiles_read_rows_once(spark):
    rows = [(float(i % 17),) for i in range(200)]
    df, seen = counted(spark, rows, "price double")
    assert distribution.quantiles(df, [], "price", {"m": 0.5}).first().m == np.median([p for p, in rows])
    assert seen.value == len(rows)


def test_moments_of_equal_values_and_nan(spark):
    df = spark.createDataFrame([("x", 0.1)] * 3 + [("y", 1.0), ("y", math.nan), ("z", math.nan)], "k string, price double")
    rows = stats.group_stats(df, ["k"], ["count", "mean", "std", "min", "max", "skewness"], {"median": 0.5}, digits=None)
    got = {r.k: r for r in rows.collect()}
    assert (got["x"]["mean"], got["x"]["std"], got["x"]["skewness"]) == (0.1, 0.0, None)
    assert set(got) == {"x", "y"} and got["y"]["count"] == 2 and math.isnan(got["y"]["mean"]) and got["y"]["median"] == 1.0
