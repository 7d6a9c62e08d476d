"""SQL functions, per-search analysis, cluster quality over several features, nearest neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.functions import sql
from offerlens.operators import cluster_quality, lof, neighbours, search_analysis as sa, segments
from offerlens.plans import catalog
from offerlens.sources import market

SF = "/root/testdata/sf0.001"


# SQL functions


def test_sql_functions_equal_their_rules(spark):
    sql.register_functions(spark)
    odd = [("HP EliteBook 840 G5 Core i5-8350U 8Go RAM 256Go SSD it's \\d", "h.p", "1.234,50 €", "eur", "Souris", 120.0, 8), ("", "", "", "", "", 0.0, 0),
           (None, None, None, None, None, None, None), ("Dell  Latitude 16384Mo", " d-link ", "N/A", " usd ", "usb", float("nan"), 64)]
    rows = spark.createDataFrame(odd, "title string, brand string, raw string, currency string, category string, price double, ram int")
    more = market.market_offers(spark, SF).limit(300).select("title", "brand", F.col("price").alias("raw"), "currency", F.lit("stand").alias("category"),
                                                             F.col("id").cast("double").alias("price"), (F.col("id") % 64).cast("int").alias("ram"))
    rows.unionByName(more).createOrReplaceTempView("odd_offers")
    column = {"title_text": "title", "brand_text": "brand", "price_text": "raw", "currency_code": "currency", "category_name": "category", "price_value": "price", "ram_size": "ram"}
    calls = ", ".join(f"{name}({', '.join(column[p] for p, _ in parameters)}) AS {name}" for name, (parameters, _, _) in sql.FUNCTIONS.items())
    got = spark.sql(f"SELECT {calls} FROM odd_offers")
    rules = [rule(*(F.col(column[p]) for p, _ in parameters)).cast(kind).alias(name) for name, (parameters, kind, rule) in sql.FUNCTIONS.items()]
    want = spark.table("odd_offers").select(*rules)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Python" not in got._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="price_mad"):
        spark.sql("SELECT price_mad(raw) FROM odd_offers")


def test_sql_text_keeps_literals(spark):
    tricky = F.concat(F.lit("it's or( and( =( 1.5 \\"), F.col("x")) == F.lit("a'b")
    df = spark.createDataFrame([("y",)], "x string")
    assert df.selectExpr(sql.sql_text(tricky)).first()[0] is False
    assert df.selectExpr(f"typeof({sql.sql_text(F.lit(0.5) + F.lit(1.25))})").first()[0] == "double"


# per-search analysis


def plain_depth(values, rng, at, depth=0):
    """Depth at which one random tree isolates values[at]."""
    if len(set(values)) == 1:
        return depth + float(sa.average_path(np.array(len(values))))
    cut = rng.uniform(min(values), max(values))
    x = values[at]
    side = [i for i, v in enumerate(values) if (v <= cut) == (x <= cut)]
    return plain_depth([values[i] for i in side], rng, side.index(at), depth + 1)


def test_expected_depths_are_the_mean_of_random_trees():
    rng = random.Random(3)
    values = [1.0, 2.0, 2.0, 3.5, 9.0, 9.5, 30.0]
    distinct, counts = np.unique(values, return_counts=True)
    expected = sa.expected_depths(distinct[None], distinct[None], counts[None])[0]
    for i, v in enumerate(distinct):
        mean = np.mean([plain_depth(values, rng, values.index(v)) for _ in range(6000)])
        assert abs(mean - expected[i]) < 0.08


def plain_cuts(values, counts):
    best = None
    z = np.repeat(values, counts)
    for a in range(1, len(values) - 1):
        for b in range(a + 1, len(values)):
            parts = [np.repeat(values[i:j], counts[i:j]) for i, j in ((0, a), (a, b), (b, len(values)))]
            loss = (round(sum(((p - p.mean()) ** 2).sum() for p in parts) / ((z - z.mean()) ** 2).sum() * 1e9), a, b)
            best = loss if best is None else min(best, loss)
    return best[1:]


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for m in (3, 4, 7, 20):
        x = np.sort(rng.choice(500, (6, m), replace=True) / 4 + np.arange(m) * 200.0, axis=1)
        c = rng.integers(1, 4, (6, m))
        mean = (x * c).sum(1) / c.sum(1)
        sd = np.sqrt((((x - mean[:, None]) ** 2) * c).sum(1) / c.sum(1))
        first, second = sa.best_cuts((x - mean[:, None]) / sd[:, None], c)
        assert [(int(a), int(b)) for a, b in zip(first, second)] == [plain_cuts(x[g], c[g]) for g in range(6)]


def test_large_searches_are_split_with_like_results(spark):
    rng = random.Random(5)
    rows = [(1, round(rng.gauss(m, 60), 2)) for m in (1000, 3000, 8000) for _ in range(700)]
    rows += [(1, 50_000.0), (2, 10.0), (2, 11.0), (2, 12.0), (2, 13.0), (2, 500.0), (3, 5.0), (3, 5.0), (3, 5.0), (4, 1.0), (None, 3.0), (5, None), (5, float("nan")), (6, 1.0), (6, 2.0)]
    prices = spark.createDataFrame(rows, "search_id long, price double")
    whole, split = sa.judged_prices(prices).toPandas(), sa.judged_prices(prices, most=200).toPandas()
    for df in (whole, split):
        assert set(df["search_id"]) == {1, 2, 3, 6}
        one = df[df["search_id"] == 1]
        assert one.groupby("cluster_id")["c"].sum().to_dict() == whole[whole["search_id"] == 1].groupby("cluster_id")["c"].sum().to_dict()
        share = (one["c"] * one["flagged"]).sum() / one["c"].sum()
        assert 0.03 < share <= 0.051 and one.loc[one["price"].idxmax(), "flagged"]
        two = df[df["search_id"] == 2].sort_values("price")
        assert two["flagged"].tolist() == [False] * 4 + [True]
        assert df[df["search_id"] == 6]["cluster_id"].isna().all() and not df[df["search_id"] == 6]["flagged"].any()
    both = whole[whole["search_id"] == 1].merge(split[split["search_id"] == 1], on="price")
    assert np.corrcoef(both["score_x"], both["score_y"])[0, 1] > 0.98
    segments_ = {(r.search_id, r.cluster_id): r for r in sa.search_clusters(sa.judged_prices(prices)).collect()}
    assert segments_[(3, 0)].rows == 3 and segments_[(3, 0)].center == 0.0 and (3, 1) not in segments_
    assert segments_[(2, 2)].name == "Premium" and segments_[(2, 2)].lowest == 500.0
    assert sa.judged_prices(prices.limit(0)).count() == 0


# cluster quality


def test_vector_quality_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 2)), 1)
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 1)
    one = np.zeros(300, dtype=int)
    lonely = np.arange(300) // 299
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))

    def plain(y):
        if len(set(y)) == 1:
            return 0.0
        s = []
        for i in range(len(y)):
            own = y == y[i]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a, b = d[i][own].sum() / (own.sum() - 1), min(d[i][y == o].mean() for o in set(y) - {y[i]})
            s.append((b - a) / max(a, b) if max(a, b) else 0.0)
        return float(np.mean(s))

    rows = [(*map(float, p), int(a), int(b), int(c)) for p, a, b, c in zip(x, y, one, lonely)]
    df = spark.createDataFrame([*rows, (None, 1.0, 0, 0, 0), (1.0, 1.0, None, 0, 0)], "a double, b double, y int, one int, lonely int")
    got = {r.labelling: r for r in cluster_quality.vector_quality(df, ["a", "b"], ["y", "one", "lonely"], block_rows=37).collect()}
    for name, labels in (("y", y), ("one", one), ("lonely", lonely)):
        assert got[name].rows == 300 and got[name].clusters == len(set(labels)) and abs(got[name].silhouette - plain(labels)) < 2e-4
    assert got["one"].davies_bouldin == 0.0 and got["lonely"].smallest == 1
    assert cluster_quality.vector_quality(df.limit(0), ["a", "b"], ["y"]).count() == 0


def test_k_by_several_features(spark):
    rng = random.Random(4)
    rows = [(i, float(m * 3 + rng.random()), m % 2 * 8, 1) for i, m in enumerate([0, 1, 2, 3] * 60)]
    df = spark.createDataFrame(rows, "id int, log_price double, ram_gb int, cpu_score int")
    scores = segments.score_k(df, range(2, 6), 4, features=["log_price", "ram_gb"])
    assert segments.choose_k(scores) == 4
    few = segments.score_k(df.limit(3).withColumn("log_price", F.lit(1.0)), range(2, 6), 2)
    assert [r.k for r in few.collect()] == [2]  # k below the number of rows, however few distinct values


# nearest neighbours


def test_nearest_rows_over_cells(spark):
    rng = np.random.default_rng(6)
    x = np.unique(np.stack([rng.normal(size=1500).round(2), rng.integers(0, 4, 1500) * 0.5], axis=1), axis=0)
    c = rng.integers(1, 4, len(x))
    df = spark.createDataFrame([(float(a), float(b), int(n)) for (a, b), n in zip(x, c)], "f0 double, f1 double, c long")
    placed = neighbours.placed_vectors(df, ["f0", "f1"], cell_vectors=60)
    assert placed.select("cell").distinct().count() > 8
    at = {r.id: (r.f0, r.f1) for r in placed.collect()}
    copies = {tuple(p): int(n) for p, n in zip(x.tolist(), c)}
    got = {}
    for r in neighbours.nearest_rows(placed, ["f0", "f1"], 7).collect():
        got.setdefault(at[r.id], []).append((r.dist, *at[r.other], r.copies))
    assert len(got) == len(x)
    for p, near in got.items():
        free = [(round(float(np.hypot(p[0] - q[0], p[1] - q[1])), 10), *q, n - (q == p)) for q, n in copies.items()]
        want, left = [], 7
        for dist, a, b, n in sorted(f for f in free if f[3]):
            if left > 0:
                want.append((dist, a, b, min(n, left)))
                left -= n
        assert sorted(near) == want


def test_lof_of_tiny_tables(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, log_price double")
    assert [r.anomaly_lof for r in lof.detect_lof(df).collect()] == [False]
    assert lof.detect_lof(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, 2.0) for i in range(50)] + [(50, 9.0)], "id int, log_price double")
    flagged = {r.id for r in lof.detect_lof(same).where("anomaly_lof").collect()}
    assert flagged == {50}


def test_registered_queries_run_on_the_smallest_tables(spark):
    for name in ("search_clusters", "search_flagged", "search_reports", "band_vector_quality", "local_outlier_factor_steps"):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_lof_leaves_no_neighbours_behind(spark):
    from pathlib import Path

    from offerlens.session import shared_folder
    folder = Path(shared_folder(spark, "x").removeprefix("file:")).parent
    left = lambda: {p.name for p in folder.glob("*near*")} if folder.exists() else set()
    before = left()
    df = spark.createDataFrame([(i, float(i * i % 97)) for i in range(120)] + [(120, 900.0)], "id int, log_price double")
    assert 120 in {r.id for r in lof.detect_lof(df).where("anomaly_lof").collect()}
    assert {n.split("-")[1] for n in left() - before} <= {"placed"}  # one row for each vector, not one for each pair
    place, taken = neighbours.first_rows(np.array([1, 0, 1, 1]), np.array([2, 1, 1, 5]), np.array([1.0, 3.0, 0.5, 1.0]), np.array([[2.0], [0.0], [7.0], [1.0]]), 3)
    assert place.tolist() == [1, 2, 3] and taken.tolist() == [1, 1, 2]
