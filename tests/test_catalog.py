import duckdb
import pytest

import __spark_entry__ as entry
from offerlens.sources.market import TABLES
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["clean_laptops", "title_features", "stats_by_brand", "detect_zscore", "laptop_rules", "jumia_cards", "upsert_offers"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    result = db.execute(entry.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == cols
    order = [found.index(c) for c in cols]
    assert compare([tuple(r) for r in df.select(*cols).collect()], [tuple(r[i] for i in order) for r in result.fetchall()]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_compute_only_the_features_they_read(spark, tmp_path):
    from offerlens.plans import catalog
    sf = str(tmp_path)
    spark.sql("""SELECT id AS l_orderkey, id % 24 AS l_partkey, id % 7 AS l_suppkey, CAST(id % 4 + 1 AS INT) AS l_linenumber, 1D AS l_quantity,
        CAST(900 + id * 37 AS DOUBLE) AS l_extendedprice, 'R' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP_NTZ '1998-01-01 00:00:00' AS l_shipdate
        FROM range(300)""").write.parquet(f"{sf}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, concat('Brand', id % 3) AS p_brand FROM range(24)").write.parquet(f"{sf}/part.parquet")
    found = catalog.QUERIES["category_counts"](spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan.lower() and "regexp_extract_all" not in plan  # no pattern of a title runs for price levels
    assert sum(r["count"] for r in found.collect()) == catalog.QUERIES["row_counts"](spark, sf).first()["rows"]
    plan = catalog.QUERIES["accessory_stats"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan
    known = catalog.featured(spark, sf, "price", "ram_gb")
    assert known.columns == ["price", "ram_gb"] and known.is_cached


def test_dashboard_persists_prices_and_brands_only(spark, tmp_path):
    from offerlens.plans import catalog
    sf = str(tmp_path)
    spark.sql("""SELECT id AS l_orderkey, id % 24 AS l_partkey, id % 7 AS l_suppkey, CAST(id % 4 + 1 AS INT) AS l_linenumber, 1D AS l_quantity,
        CAST(900 + id * 37 AS DOUBLE) AS l_extendedprice, 'R' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP_NTZ '1998-01-01 00:00:00' AS l_shipdate
        FROM range(300)""").write.parquet(f"{sf}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, concat('Brand', id % 3) AS p_brand FROM range(24)").write.parquet(f"{sf}/part.parquet")
    found = catalog.QUERIES["dashboard"](spark, sf).first()
    assert {tuple(df.columns) for (_, _, folder), df in catalog._tables.items() if folder == sf} == {("price", "brand_detected")}
    rows = catalog.laptops_once(spark, sf).select("price", "brand_detected").collect()
    assert (found["offers"], found["brands"]) == (len(rows), len({r.brand_detected for r in rows}))


def test_forest_check_persists_only_what_it_reads(spark, tmp_path):
    from offerlens.plans import catalog
    sf = str(tmp_path)
    spark.sql("""SELECT id AS l_orderkey, id % 24 AS l_partkey, id % 7 AS l_suppkey, CAST(id % 4 + 1 AS INT) AS l_linenumber, 1D AS l_quantity,
        CAST(900 + id * 37 AS DOUBLE) AS l_extendedprice, 'R' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP_NTZ '1998-01-01 00:00:00' AS l_shipdate
        FROM range(300)""").write.parquet(f"{sf}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, concat('Brand', id % 3) AS p_brand FROM range(24)").write.parquet(f"{sf}/part.parquet")
    found = catalog.QUERIES["forest_check"](spark, sf).first()
    assert {tuple(df.columns) for (_, _, folder), df in catalog._tables.items() if folder == sf} == {("id", "link", "price", *catalog.VECTOR)}
    assert found["rows"] == catalog.laptops_once(spark, sf).count() and found["scores_hold"] and found["flagged_lie_below"]
