import pytest
from pyspark.sql import functions as F

from offerlens.functions import features, prices, titles


def column_of(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


PRICES = [
    ("199,00", 199.0), ("1.999,00", 1999.0), ("1,999.00", 1999.0), ("1.234.567", 1234.567), ("12 500,00 MAD", 12500.0),
    ("-5", 5.0), ("0", None), ("", None), ("N/A", None), (None, None), ("1,234,567", 1234.567), (".", None),
    ("1.234.567,89", 1234567.89), ("5.", 5.0), ("1,999.00.5", 199900.5),
]


def test_parse_price(spark):
    assert column_of(spark, [p for p, _ in PRICES], prices.parse_price) == [v for _, v in PRICES]


def test_price_in_mad(spark):
    df = spark.createDataFrame([("100", "EUR"), ("100", " usd "), ("100", "xyz"), ("100", None), ("7", "£")], "p string, c string")
    got = [r[0] for r in df.select(prices.price_in_mad(F.col("p"), F.col("c"))).collect()]
    assert got == [1100.0, 1000.0, 100.0, 100.0, 91.0]


@pytest.mark.parametrize("fn, given, wanted", [
    (prices.offer_insert_price, ["N/A", None, "", "12 500,5", "1 000", "12 DH"], [0.0, 0.0, 0.0, 12500.5, 1000.0, 0.0]),
    (prices.accessory_insert_price, ["N/A", "", None, "3,5", "x"], [0.0, 0.0, 0.0, 3.5, None]),
    (prices.refresh_price, ["3,5 DH", "x", None, "1.2.3"], [3.5, 0.0, 0.0, 0.0]),
    (prices.digits_price, ["12 500,00 MAD", "", None], [1250000, 0, 0]),
    (prices.marketplace_price, ["5.899,99", "5,899.99", "12,50", "a"], [5899.99, 5899.99, 12.5, 0.0]),
    (prices.card_currency, ["1 299,00 €", "N", "$5"], ["€", "N/A", "$"]),
    (prices.detect_currency, ["MAD 5", "5€", "US $5", "Fr 5", "5"], ["MAD", "EUR", "USD", "Fr", "inconnu"]),
])
def test_raw_price_formats(spark, fn, given, wanted):
    assert column_of(spark, given, fn) == wanted


RAM = [("pc 8192Mo", 8), ("256Go SSD 4Go RAM", 4), ("8go 256go ssd", 8), ("16gb laptop", 16), ("ram: 12 go", 12), ("rien", None),
       ("256Go SSD 16Go", 16), ("7go", None), ("64Go eMMC", 64), (None, None), ("999999999999999999999go", None)]
STORAGE = [("1To NVMe", 1000), ("1.5 tb", 1500), ("256 SSD", 256), ("512Go SSD", 512), ("ssd 480 go", 480), ("8go 256go", 256),
           ("64 go rapide emmc", 64), ("16go", None), ("emmc rapide 64 go", 64), ("8Go", None)]
CPU = [("Core Ultra 9", 10), ("i7-1165G7", 7), ("MacBook M3 Pro", 10), ("Celeron N4020", 1), ("Ryzen AI 9", 9), ("x", 0), ("M2", 7)]
GEN = [("i7-1165G7", 11), ("Core i5 8th gen", 8), ("11ème gén", 11), ("gen 3", None), ("i5 10e gen", 10), ("x", None)]
BRANDS = [("Pavillon 15", "x", "HP"), ("Pavilion 15", "x", "Autre"), ("portable", "hp", "HP"), ("portable", "d-link", "D-Link"), ("portable", "", "Autre"),
          ("LG gram", None, "LG"), ("Dell g15", None, "Dell"), ("programme", None, "Autre"), ("mac  book", None, "Apple")]


@pytest.mark.parametrize("fn, cases", [
    (titles.extract_ram, RAM), (titles.extract_storage, STORAGE), (titles.cpu_score, CPU), (titles.cpu_generation, GEN),
])
def test_title_numbers(spark, fn, cases):
    assert column_of(spark, [t for t, _ in cases], fn) == [v for _, v in cases]


def test_brand(spark):
    df = spark.createDataFrame([(t, b) for t, b, _ in BRANDS], "t string, b string")
    got = [r[0] for r in df.select(titles.detect_brand(F.col("t"), F.col("b"))).collect()]
    assert got == [w for *_, w in BRANDS]


def test_flags_and_labels(spark):
    assert column_of(spark, ["programme", "pc", None], titles.is_gaming_title) == [True, False, False]
    assert column_of(spark, ["MacBook", "souris", None], titles.is_laptop_title) == [True, False, False]
    assert column_of(spark, ["RTX 4060", "grtx"], titles.has_gpu) == [True, False]
    assert column_of(spark, [2999.0, 3000.0, 22000.0], features.price_category, "double") == [
        "entrée_de_gamme", "milieu_de_gamme_bas", "premium"]
    assert column_of(spark, [None, 4, 32], features.ram_category, "int")[0] == "Inconnu"
    assert column_of(spark, [None], lambda c: features.ram_category(c, compat=True), "int") == ["Haute perf (≥32GB)"]
    assert column_of(spark, ["is_gaming=is_gaming=Oui, price_category=haut_de_gamme"], features.rule_label) == [
        "gaming=Oui, gamme=haut de gamme"]
    assert column_of(spark, ["  a   b "], titles.collapse_blanks) == ["a b"]
