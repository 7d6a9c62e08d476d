"""The whole report and its JSON document."""

import json
import math
import threading

import pytest

from offerlens.functions import prices
from offerlens.plans import report
from offerlens.sources import market

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    offers = market.market_offers(spark, SF)
    offers = offers.withColumn("price", prices.marketplace_price(offers["price"]))
    return report.market_report(offers, market.market_accessories(spark, SF), restarts=2)


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) or math.isinf(x) else x
    return x


def test_every_key_equals_its_result(results, tmp_path):
    document = report.payload(results)
    whole = json.loads(document.first()[0])
    assert list(whole) == ["laptops", "accessories", "cross_association"]
    assert len(whole["laptops"]) == 15 and len(whole["accessories"]) == 3
    keys = {(r.section, r.name): json.loads(r.json) for r in report.payload_keys(document).collect()}
    assert len(keys) == 19
    for (section, name), value in keys.items():
        inside = whole[section] if section == "cross_association" else whole[section][name]
        assert inside == value
        source, order = report.PAYLOAD[section][name]
        want = [{k: plain(v) for k, v in r.asDict().items()} for r in results[source].collect()]
        got = value if order else [value]
        fixed = lambda rows: sorted(json.dumps(r, sort_keys=True, default=str) for r in rows)
        assert fixed(got) == fixed(want), name
    assert [r["k"] for r in whole["laptops"]["k_scores"]] == sorted(r["k"] for r in whole["laptops"]["k_scores"])
    assert len(whole["laptops"]["pca_scatter"]) == 300 and len(whole["laptops"]["radar_clusters"]) >= 2
    counts = [r["count"] for r in whole["laptops"]["brand_bar"]]
    assert counts == sorted(counts, reverse=True)
    report.write_payload(results, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.txt"))
    assert json.loads(text)["laptops"]["best_k"]["best_k"] >= 5


def test_results_are_saved_as_tables(spark, results, tmp_path):
    some = {k: results[k] for k in ("stats", "histogram")}
    report.save_report(spark, some, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "histogram")).count() == 12


def test_prepare_reads_offers_once(spark):
    rows = [(i, f"HP EliteBook 840 {i % 3} 8Go RAM 256Go SSD", 3000.0 + 10 * (i % 40), "MAD", "HP", "Jumia", f"l{i % 90}", False) for i in range(200)]
    schema = "id long, title string, price double, currency string, brand string, source string, link string, is_gaming boolean"
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    got = report.prepare(spark.createDataFrame(rows, schema).mapInPandas(count, schema)).collect()
    assert len(got) == 90 and seen.value == len(rows)
    prices = sorted(r["price"] for r in got)
    low, mid, high = (prices[int(89 * q)] + (prices[min(int(89 * q) + 1, 89)] - prices[int(89 * q)]) * (89 * q % 1) for q in (0.25, 0.5, 0.75))
    assert all(abs(r["price_scaled"] - (r["price"] - mid) / (high - low)) < 1e-5 for r in got)


def test_branches_run_side_by_side(spark):
    both = threading.Barrier(2, timeout=60)

    def branch(name):
        def run():
            both.wait()  # passes only if the other branch runs at the same time
            return {name: spark.range(1)}
        return run

    assert set(report.side_by_side(spark, branch("a"), branch("b"))) == {"a", "b"}
