"""Oracle SQL: the registered queries written once more as plain SQL on the test tables.

The statements use a different formulation where they can (windows instead of
aggregates, built-in quantiles instead of bucketed counts, no lookaheads).
"""

from __future__ import annotations

from itertools import combinations

from offerlens import dims
from offerlens.sources.market import (
    ACCESSORIES_SQL, ALERTS_SQL, BAGS_SQL, OFFERS_SQL, PRICES_SQL, PRODUCTS_SQL, SEARCHES_SQL,
)


def r(x: str, digits: int = 2) -> str:
    """Round to digits with ties to even."""
    y, s = f"round(CAST({x} AS DOUBLE)*1e{digits}, 6)", f"1e{digits}"
    f = f"floor({y})"
    return f"((CASE WHEN {y}-{f}>0.5 OR ({y}-{f}=0.5 AND {f}%2<>0) THEN {f}+1 ELSE {f} END)/{s})"


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rate(column: str, rates: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {v}e0" for k, v in rates.items()) + " ELSE 1e0 END"


def levels(x: str, table: list, top: str, sign: str = "<") -> str:
    return "CASE " + " ".join(f"WHEN {x} {sign} {b} THEN {quote(n)}" for b, n in table) + f" ELSE {quote(top)} END"


MAD = f"""offers AS ({OFFERS_SQL}),
s1 AS (SELECT *, regexp_replace(price, '[^0-9,.]', '', 'g') AS s FROM offers),
s2 AS (SELECT *, CASE WHEN contains(s, ',') AND contains(s, '.') THEN
    CASE WHEN strpos(s, ',') > strpos(s, '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END
    ELSE replace(s, ',', '.') END AS t FROM s1),
s3 AS (SELECT *, CASE WHEN length(t) - length(replace(t, '.', '')) > 1
    THEN replace(regexp_extract(t, '^(.*)\\.[^.]*$', 1), '.', '') || '.' || regexp_extract(t, '([^.]*)$', 1)
    ELSE t END AS u FROM s2),
num AS (SELECT *, nullif(TRY_CAST(u AS DOUBLE), 0e0) AS free, {rate("upper(trim(currency))", dims.LAPTOP_RATES)} AS rate FROM s3),
mad AS (SELECT id, title, {r("free * rate")} AS price, currency, brand, source, link, search_query, page, is_gaming, date_scraped FROM num)"""

NEWEST = ("id DESC NULLS LAST, title DESC NULLS LAST, price DESC NULLS LAST, currency DESC, brand DESC, source DESC, "
          "link DESC, search_query DESC, page DESC, is_gaming DESC, date_scraped DESC")


def cleaned(name: str, bounds: tuple[float, float], where: str = "true") -> str:
    return (
        f"{name} AS (SELECT id, regexp_replace(trim(title), '\\s+', ' ', 'g') AS title, price, currency, brand, source, link, "
        f"search_query, page, is_gaming, date_scraped FROM (SELECT * FROM mad WHERE price BETWEEN {bounds[0]} AND {bounds[1]} "
        f"AND {where} QUALIFY row_number() OVER (PARTITION BY link ORDER BY {NEWEST}) = 1))"
    )


CLEAN = MAD + ", " + cleaned("clean", dims.PRODUCT_BOUNDS["laptop"])
RAM = ",".join(map(str, dims.RAM_SIZES))
STO = ",".join(map(str, dims.STORAGE_SIZES))
ONLY = ",".join(str(x) for x in dims.STORAGE_SIZES if x not in dims.RAM_SIZES)
UNIT = r"(\d+)\s*(?:go|gb|g)\b"


def one(pattern: str) -> str:
    return f"TRY_CAST(regexp_extract(t, '{pattern}', 1) AS BIGINT)"


def valid(x: str, allowed: str) -> str:
    return f"CASE WHEN {x} IN ({allowed}) THEN {x} END"


def every(text: str, allowed: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({text}, '{UNIT}', 1), lambda x: TRY_CAST(x AS BIGINT)), "
            f"lambda x: x IN ({allowed}))")


def rules_case(table: list, otherwise: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches(t, {quote(p)}) THEN {quote(v) if isinstance(v, str) else v}" for v, p in table
    ) + f" ELSE {otherwise} END"


FREE = (r"regexp_replace(t, '(?s)\d+\s*(?:go|gb|g)\b(?:.{0,7}?(?:ssd|hdd)|.{0,6}?(?:nvme|emmc|stor)|.{0,4}?disque)', '|', 'g')")
RAM_SQL = "coalesce(" + ", ".join([
    valid(one(r"(\d+)\s*mo\b") + "//1024", RAM),
    valid(one(r"(\d+)\s*(?:go|gb)\s*(?:ram|ddr\d*|lpddr\d*|sdram)"), RAM),
    valid(one(r"(?:ram|memoire|memory|mem)\s*:?\s*(\d+)\s*(?:go|gb|g\b)"), RAM),
    every(FREE, RAM) + "[-1]", every("t", RAM) + "[1]",
]) + ")"
STO_SQL = "coalesce(" + ", ".join([
    r"CAST(floor(TRY_CAST(regexp_extract(t, '(\d+(?:\.\d+)?)\s*(?:to|tb)\b', 1) AS DOUBLE) * 1000) AS BIGINT)",
    valid(one(r"(\d+)\s*(?:go|gb|g)\s*(?:ssd|hdd|nvme|emmc|disque|flash)"), STO),
    valid(one(r"(?:ssd|hdd|nvme|emmc)\s*[\s:]*(\d+)\s*(?:go|gb|g)\b"), STO),
    valid(one(r"(\d+)\s+(?:ssd|hdd|nvme)"), STO), every("t", ONLY) + "[1]",
]) + ")"
first, last = dims.GENERATION_RANGE
GEN_SQL = "coalesce(" + ", ".join(
    f"CASE WHEN {one(p)} BETWEEN {first} AND {last} THEN {one(p)} END" for p, _ in dims.CPU_GENERATIONS
) + ")"
GAMING = "(" + " OR ".join(f"contains(t, {quote(w)})" for w in dims.GAMING_WORDS) + ")"
BRAND = rules_case(
    dims.BRAND_PATTERNS,
    "CASE WHEN length(trim(brand)) > 1 THEN upper(left(trim(brand), 1)) || lower(substr(trim(brand), 2)) ELSE 'Autre' END",
)
FEATURES = CLEAN + f""", low AS (SELECT *, lower(title) AS t FROM clean),
f1 AS (SELECT *, {BRAND} AS brand_detected, CAST({RAM_SQL} AS INT) AS ram_gb, CAST({STO_SQL} AS INT) AS storage_gb,
  {rules_case([(n, p) for n, p in dims.STORAGE_KINDS], "'Inconnu'")} AS storage_type,
  {rules_case(dims.CPU_SCORES, "0")} AS cpu_score, CAST({GEN_SQL} AS INT) AS cpu_generation,
  regexp_matches(t, '{dims.GPU_PATTERN}') AS has_gpu, regexp_matches(t, '{dims.TOUCH_PATTERN}') AS is_tactile,
  regexp_matches(t, '{dims.REFURBISHED_PATTERN}') AS is_refurbished,
  {levels("price", dims.PRICE_LEVELS, dims.TOP_PRICE_LEVEL)} AS price_category, is_gaming OR {GAMING} AS gaming,
  log10(greatest(price, 1e0)) AS log_price FROM low),
laptops AS (SELECT * EXCLUDE (is_gaming, gaming, t), gaming AS is_gaming,
  CASE WHEN ram_gb IS NULL THEN 'Inconnu' ELSE {levels("ram_gb", dims.RAM_LEVELS, dims.TOP_RAM_LEVEL, "<=")} END AS ram_category,
  {r("price / ram_gb")} AS price_per_gb_ram FROM f1)"""
BANDED = FEATURES + ", banded AS (SELECT *, " + "CASE " + " ".join(
    f"WHEN price >= {a} AND price < {z} THEN {i}" for i, (a, z, _) in enumerate(dims.PRICE_BANDS)
) + " ELSE 4 END AS cluster_id, " + "CASE " + " ".join(
    f"WHEN price >= {a} AND price < {z} THEN {quote(n)}" for a, z, n in dims.PRICE_BANDS
) + " ELSE 'Premium' END AS cluster FROM laptops)"


def by_category(pairs: dict, which: int, other: float) -> str:
    return "CASE lower(category) " + " ".join(f"WHEN {quote(k)} THEN {v[which]}" for k, v in pairs.items()) + f" ELSE {other} END"


def accessories(request: bool = False) -> str:
    rates = dims.ACCESSORY_VIEW_RATES if request else dims.ACCESSORY_RATES
    bounds = dims.ACCESSORY_VIEW_BOUNDS if request else dims.ACCESSORY_BOUNDS
    key = "upper(trim(currency))" if request else "upper(currency)"
    low, high = (by_category(bounds, i, dims.OTHER_ACCESSORY_BOUNDS[i]) for i in (0, 1))
    cut1, cut2 = (by_category(dims.ACCESSORY_RANGE_CUTS, i, dims.OTHER_ACCESSORY_RANGE_CUTS[i]) for i in (0, 1))
    return f"""raw AS ({ACCESSORIES_SQL}),
conv AS (SELECT * REPLACE (TRY_CAST(price AS DOUBLE) * {rate(key, rates)} AS price) FROM raw),
accessories AS (SELECT * EXCLUDE (category), category AS accessory_category,
  CASE WHEN price < {cut1} THEN 'bas' WHEN price < {cut2} THEN 'moyen' ELSE 'haut' END AS price_range
  FROM conv WHERE price > 0 AND category IS NOT NULL AND price BETWEEN {low} AND {high})"""


ACC = accessories()
ORACLES: dict[str, str] = {}


def add(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes} {select}" if ctes else select


# --- reading, cleaning, writing
add("load_laptops", f"offers AS ({OFFERS_SQL})", """SELECT * REPLACE (TRY_CAST(price AS DOUBLE) AS price) FROM offers
  WHERE TRY_CAST(price AS DOUBLE) BETWEEN 1500 AND 150000""")
add("clean_laptops", CLEAN, "SELECT * FROM clean")
IS_LAPTOP = "(" + " OR ".join(f"contains(lower(title), {quote(w)})" for w in dims.LAPTOP_WORDS) + ")"
add("global_cleaning_laptops", MAD + ", " + cleaned("clean", dims.PRODUCT_BOUNDS["laptop"], IS_LAPTOP),
    "SELECT * REPLACE ('MAD' AS currency) FROM clean")
add("global_cleaning_accessories", MAD + ", " + cleaned("clean", dims.PRODUCT_BOUNDS["accessory"], f"NOT {IS_LAPTOP}"),
    "SELECT * REPLACE ('MAD' AS currency) FROM clean")
add("prepare_accessories", ACC, "SELECT * FROM accessories")
add("prepare_accessories_request", accessories(True), "SELECT * FROM accessories")
add("export_rows", FEATURES, """SELECT title, CAST(price AS VARCHAR) AS price, brand_detected, source, price_category,
  coalesce(CAST(ram_gb AS VARCHAR), '') AS ram_gb, coalesce(CAST(storage_gb AS VARCHAR), '') AS storage_gb,
  CAST(is_gaming AS VARCHAR) AS is_gaming FROM laptops""")
add("drop_incomplete", f"mad AS (SELECT * REPLACE (TRY_CAST(price AS DOUBLE) AS price) FROM ({OFFERS_SQL}))",
    f"SELECT * FROM mad WHERE price >= 1500 QUALIFY row_number() OVER (PARTITION BY link ORDER BY {NEWEST}) = 1")
COLUMNS = ["id", "title", "price", "currency", "brand", "source", "link", "search_query", "page", "is_gaming", "date_scraped"]
add("missing_counts", f"offers AS ({OFFERS_SQL})", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in COLUMNS
) + ", count(*) FILTER (WHERE TRY_CAST(price AS DOUBLE) = 0) AS zero_prices FROM offers")
COMMA = "replace(replace(price, ' ', ''), ',', '.')"
add("import_laptops", f"offers AS ({OFFERS_SQL})", f"""SELECT title, coalesce(TRY_CAST({COMMA} AS DOUBLE), 0e0) AS price, currency,
  left(brand, 50) AS brand, source, link, search_query, page, is_gaming, date_scraped FROM offers""")
_flag = "CASE WHEN is_gaming THEN 'True' ELSE 'False' END"
_cells = ["title", "price", "currency", "brand", "source", "link", "''", "search_query", "page", _flag, "strftime(date_scraped, '%Y-%m-%d %H:%M:%S')"]
_length = " + ".join(f"length(CAST({c} AS VARCHAR)) + 2" for c in _cells) + " + 10"
add("csv_rows", f"offers AS ({OFFERS_SQL})", f"""SELECT title, coalesce(TRY_CAST({COMMA} AS DOUBLE), 0e0) AS price, currency,
  left(brand, 50) AS brand, source, link, search_query, page, is_gaming, CASE WHEN id % 89 <> 0 THEN date_scraped END AS date_scraped
  FROM offers WHERE id % 97 <> 0 AND id % 101 <> 0""")
add("csv_rejects", f"offers AS ({OFFERS_SQL})", f"""SELECT CASE WHEN id % 97 = 0 THEN 'too many fields' ELSE 'open quote' END AS reason, count(*) AS lines,
  CAST(sum(CASE WHEN id % 97 = 0 THEN {_length} + 1 ELSE length(source) + 6 END) AS BIGINT) AS characters FROM offers WHERE id % 97 = 0 OR id % 101 = 0 GROUP BY 1""")
add("import_accessories", f"offers AS ({OFFERS_SQL})", """SELECT 'mouse' AS category, title,
  TRY_CAST(replace(price, ',', '.') AS DOUBLE) AS price, 'EUR' AS currency, brand, source, link, search_query, page,
  true AS in_stock, is_gaming, date_scraped FROM offers WHERE TRY_CAST(replace(price, ',', '.') AS DOUBLE) IS NOT NULL""")
add("refresh_offers", f"offers AS ({OFFERS_SQL})", """SELECT title,
  coalesce(TRY_CAST(regexp_replace(replace(price, ',', '.'), '[^0-9.]', '', 'g') AS DOUBLE), 0e0) AS price,
  CASE WHEN currency = '' THEN 'MAD' ELSE currency END AS currency, brand, source, link, search_query, page, is_gaming,
  date_scraped FROM offers""")
add("price_parsers", MAD, f"""SELECT id, price AS raw, free, coalesce(TRY_CAST({COMMA} AS DOUBLE), 0e0) AS insert_price,
  TRY_CAST(replace(price, ',', '.') AS DOUBLE) AS accessory_insert,
  coalesce(TRY_CAST(regexp_replace(replace(price, ',', '.'), '[^0-9.]', '', 'g') AS DOUBLE), 0e0) AS refresh,
  coalesce(TRY_CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT), 0) AS digits,
  coalesce(TRY_CAST(CASE WHEN contains(s, ',') AND contains(s, '.') AND
    strpos(reverse(s), ',') > strpos(reverse(s), '.') THEN replace(s, ',', '')
    WHEN contains(s, ',') AND contains(s, '.') THEN replace(replace(s, '.', ''), ',', '.')
    ELSE replace(s, ',', '.') END AS DOUBLE), 0e0) AS marketplace,
  coalesce({r("TRY_CAST(replace(s, ',', '.') AS DOUBLE)")}, 0e0) AS card,
  CASE WHEN contains(price, 'MAD') THEN 'MAD' ELSE 'inconnu' END AS currency, rate,
  {rate("upper(currency)", dims.ACCESSORY_RATES)} AS accessory_rate FROM num""")
add("title_features", FEATURES, """SELECT id, title, price, brand_detected, ram_gb, storage_gb, storage_type, cpu_score,
  cpu_generation, has_gpu, is_tactile, is_refurbished, price_category, ram_category, is_gaming FROM laptops""")
ORACLES["sql_title_features"], ORACLES["sql_price_parsers"] = ORACLES["title_features"], ORACLES["price_parsers"]
add("price_features", FEATURES, f"""SELECT id, link, round(log_price, 9) AS log_price, price_per_gb_ram,
  {levels("price", dims.BASKET_PRICE_LEVELS, "premium", "<=")} AS basket_level FROM laptops""")
add("text_helpers", f"offers AS ({OFFERS_SQL})", f"""SELECT id, regexp_extract(title, '\\S+') AS brand_word,
  regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS norm_title, md5(link) AS link_id,
  regexp_replace(trim(title), '\\s+', ' ', 'g') AS tidy, {IS_LAPTOP} AS is_laptop,
  regexp_matches(lower(title), 'gaming|gamer|rog|predator') AS acc_gaming, left(title, 40) AS short,
  'https://shop.example/item/' || CAST(page AS VARCHAR) AS url FROM offers""")

# --- search and filters
add("search_by_query", FEATURES, "SELECT id, title, price, search_query FROM laptops WHERE lower(search_query) LIKE '%laptop%'")
add("search_offers", FEATURES, """SELECT id, title, price FROM laptops WHERE lower(title) LIKE '%gaming%'
  OR lower(brand) LIKE '%gaming%' OR lower(search_query) LIKE '%gaming%'""")
add("search_accessories", ACC, """SELECT id, title, accessory_category AS category, price FROM accessories
  WHERE concat_ws(chr(10), lower(title), lower(brand), lower(search_query), lower(accessory_category)) LIKE '%usb%'""")
add("page_of_offers", FEATURES, "SELECT id, link, title, price FROM laptops ORDER BY id DESC, link DESC, title DESC, price DESC LIMIT 20 OFFSET 40")
add("page_after_offer", FEATURES, """SELECT DISTINCT * FROM (SELECT id, link, title, price FROM laptops)
  ORDER BY id DESC, link DESC, title DESC, price DESC LIMIT 20 OFFSET 40""")
add("page_counts", FEATURES, """SELECT count(*) AS total, count(*) // 20 + CAST(count(*) % 20 > 0 AS BIGINT) AS pages,
  greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages_min_one FROM laptops""")
add("filter_products", f"products AS ({PRODUCTS_SQL}), prices AS ({PRICES_SQL})", """SELECT DISTINCT p.* FROM products p
  JOIN prices a ON a.product_id = p.product_id AND a.price >= 100000
  JOIN prices b ON b.product_id = p.product_id AND b.price <= 2000 WHERE p.category = 'ECONOMY'""")
add("latest_searches_per_user", f"searches AS ({SEARCHES_SQL})", """SELECT * FROM searches
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, search_id DESC) <= 5""")
add("recent_searches", f"searches AS ({SEARCHES_SQL})", """SELECT * FROM searches WHERE user_id = 7
  AND created_at >= TIMESTAMP '1998-08-01' - INTERVAL 365 DAY ORDER BY created_at DESC, search_id DESC LIMIT 10""")
add("active_alerts", f"alerts AS ({ALERTS_SQL})", "SELECT * FROM alerts WHERE user_id = 7 AND is_active")
for family, (wanted, unwanted, lowest) in dims.LISTING_RULES.items():
    text = "' ' || lower(title) || ' '" if family == "laptop" else "lower(title)"
    yes = " OR ".join(f"strpos({text}, {quote(w)}) > 0" for w in wanted)
    no = " OR ".join(f"strpos({text}, {quote(w)}) > 0" for w in unwanted)
    add(f"relevant_listings_{family}", f"offers AS ({OFFERS_SQL})",
        f"""SELECT id, title, CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT) AS price FROM offers
        WHERE ({yes}) AND NOT ({no}) AND CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT) >= {lowest}""")
ORACLES["bag_listings"] = ORACLES["relevant_listings_bag"].replace(OFFERS_SQL, BAGS_SQL)
add("nulls_for_json", FEATURES, "SELECT id, price / nullif(cpu_score, 0) AS ratio FROM laptops")
add("accessory_gaming", ACC, "SELECT id, title, regexp_matches(lower(title), 'gaming|gamer|rog|predator') AS is_gaming FROM accessories")

# --- deduplication
add("dedup_links", MAD, f"SELECT * FROM mad QUALIFY row_number() OVER (PARTITION BY link ORDER BY {NEWEST}) = 1")
add("dedup_without_link", MAD, """SELECT title, price, source, brand, page FROM mad QUALIFY row_number() OVER (
  PARTITION BY title, price, source ORDER BY currency DESC, brand DESC, search_query DESC, page DESC) = 1""")
add("dedup_listing", MAD, f"""SELECT id, title, price, source, link FROM mad QUALIFY row_number() OVER (
  PARTITION BY lower(trim(title)), {r("price", 0)}, source ORDER BY id, title, price, source, link) = 1""")
add("dedup_display", FEATURES, """SELECT id, title, price, link FROM laptops QUALIFY row_number() OVER (
  PARTITION BY left(title, 60), price ORDER BY id, title, price, link) = 1""")
add("product_key", f"products AS ({PRODUCTS_SQL})", "SELECT DISTINCT title, platform, category FROM products")

# --- upserts and history
HALVES = MAD + """, priced AS (SELECT * REPLACE (coalesce(price, 0e0) AS price) FROM mad),
halves AS (SELECT *, CASE WHEN date_scraped >= TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS part FROM priced)"""
OLDEST = "part, date_scraped, id, title, price, currency, brand, source, link, search_query, page, is_gaming"
LATEST = ", ".join(f"{c} DESC" for c in OLDEST.split(", "))
for kind, updated in [("offers", ["price", "date_scraped"]), ("accessories", ["price", "currency", "date_scraped"])]:
    shown = ["link", "title", "price", "currency", "date_scraped"]
    picks = ", ".join(c if c == "link" else f"{'l' if c in updated else 'f'}.{c}" if c != "link" else c for c in shown).replace("link,", "f.link,", 1)
    add(f"upsert_{kind}", HALVES + f""",
f AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY link ORDER BY {OLDEST}) = 1),
l AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY link ORDER BY {LATEST}) = 1)""",
        f"SELECT {picks} FROM f JOIN l ON f.link = l.link")
ORACLES["upsert_streamed"] = ORACLES["upsert_offers"]
_box = ", ".join(f"{r(x)} AS {n}" for n, x in {
    "mean": "avg(l.price)", "min": "min(l.price)", "max": "max(l.price)", "std": "stddev_samp(l.price)", "q1": "quantile_cont(l.price, 0.25)",
    "median": "quantile_cont(l.price, 0.5)", "q3": "quantile_cont(l.price, 0.75)"}.items())
add("stats_upkept", HALVES + f""",
f AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY link ORDER BY {OLDEST}) = 1),
l AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY link ORDER BY {LATEST}) = 1)""",
    f"SELECT f.source AS source, count(*) AS count, {_box} FROM f JOIN l ON f.link = l.link GROUP BY 1")
add("price_drops", HALVES + f""", stored AS (SELECT link, price AS old FROM halves WHERE part = 0
  QUALIFY row_number() OVER (PARTITION BY link ORDER BY {LATEST}) = 1)""", f"""SELECT title, {r("old")} AS old_price,
  {r("price")} AS new_price, {r("old - price")} AS diff, {r("(old - price) / old * 100", 1)} AS percentage, currency, h.link, source
  FROM halves h JOIN stored USING (link) WHERE part = 1 AND price > 0 AND price < old""")
EVENTS = "ev AS (SELECT event_id, user_id, ts, value AS price FROM events WHERE value IS NOT NULL)"
SEEN = EVENTS + ", seen AS (SELECT *, lag(price) OVER (PARTITION BY user_id ORDER BY ts, event_id, price) AS old_price FROM ev)"
add("previous_price", SEEN, "SELECT * FROM seen")
add("drops_over_time", SEEN, f"""SELECT user_id, ts, event_id, {r("old_price")} AS old_price, {r("price")} AS new_price,
  {r("old_price - price")} AS diff, {r("(old_price - price) / old_price * 100", 1)} AS percentage FROM seen
  WHERE price > 0 AND price < old_price""")
ORACLES["price_drops_streamed"] = ORACLES["drops_over_time"]
add("product_history", f"products AS ({PRODUCTS_SQL}), prices AS ({PRICES_SQL}), h AS (SELECT product_id, "
    "arg_max(price, (scraped_at, price)) AS latest, min(price) AS lo, max(price) AS hi, avg(CAST(price AS DOUBLE)) AS mean FROM prices GROUP BY 1)",
    f"""SELECT p.product_id, title, category, CAST(latest AS DOUBLE) AS latest_price,
  CASE WHEN latest IS NOT NULL THEN platform END AS platforms, coalesce(CAST(lo AS DOUBLE), 0e0) AS min_price,
  coalesce(CAST(hi AS DOUBLE), 0e0) AS max_price, {r("coalesce(mean, 0e0)")} AS avg_price FROM products p LEFT JOIN h USING (product_id)""")
add("search_prices", f"products AS ({PRODUCTS_SQL}), prices AS ({PRICES_SQL}), searches AS ({SEARCHES_SQL})",
    """SELECT search_id, query, product_id, title, platform, price, scraped_at FROM searches JOIN prices USING (search_id)
  JOIN products USING (product_id)""")
add("searches_with_counts", f"prices AS ({PRICES_SQL}), searches AS ({SEARCHES_SQL})", """SELECT s.*,
  (SELECT count(*) FROM prices p WHERE p.search_id = s.search_id) AS product_count, status = 'F' AS has_analysis FROM searches s""")


# --- statistics
def q(p: float) -> str:
    return f"quantile_cont(price, {p})"


def measures(names: list[str], digits: int | None = 2) -> str:
    sql = {"count": "count(price)", "mean": "avg(price)", "median": q(0.5), "std": "stddev_samp(price)", "min": "min(price)",
           "max": "max(price)", "p10": q(0.1), "p25": q(0.25), "p75": q(0.75), "p90": q(0.9), "q1": q(0.25), "q3": q(0.75)}
    return ", ".join(
        f"{sql[n] if n == 'count' or digits is None else r(sql[n], digits)} AS {n}" for n in names
    )


CENTRAL = "(SELECT avg(price) AS m FROM laptops)"
MOMENT = "avg((price - m) * (price - m){})"
add("descriptive_stats", FEATURES, f"""SELECT * EXCLUDE (m2, m3, m4, sd, mn, iq),
  {r("iq")} AS iqr, {r("m3 / pow(m2, 1.5)", 4)} AS skewness, {r("m4 / (m2 * m2) - 3", 4)} AS kurtosis, {r("sd / mn * 100")} AS cv
  FROM (SELECT {measures(["count", "mean", "median", "std", "min", "max", "p25", "p75", "p90"])}, {q(0.75)} - {q(0.25)} AS iq,
  {MOMENT.format("")} AS m2, {MOMENT.format(" * (price - m)")} AS m3, {MOMENT.format(" * (price - m) * (price - m)")} AS m4,
  stddev_samp(price) AS sd, avg(price) AS mn FROM laptops, {CENTRAL})""")
add("price_percentiles", FEATURES, f"SELECT {measures(['p10', 'p25', 'median', 'p75', 'p90', 'mean', 'std'])} FROM laptops")
add("stats_by_brand", FEATURES, f"""SELECT *, {r("std / mean * 100")} AS cv FROM (SELECT brand_detected,
  {measures(["count", "mean", "median", "std", "min", "max", "p25", "p75"])} FROM laptops GROUP BY 1)""")
add("stats_by_category", FEATURES, f"SELECT price_category, {measures(['count', 'mean', 'median', 'min', 'max'])} FROM laptops GROUP BY 1")
BOX = ["count", "min", "q1", "median", "mean", "q3", "max", "std"]
add("stats_by_source", FEATURES, f"SELECT source, {measures(BOX)} FROM laptops GROUP BY 1 HAVING count(price) >= 3")
add("boxplot_by_source", FEATURES, f"""SELECT source, {measures(["count", "min", "q1", "median", "q3", "max"], None)},
  {measures(["mean", "std"])} FROM laptops GROUP BY 1""")
TOP = "GROUP BY 1 ORDER BY count DESC, brand_detected LIMIT"
add("brand_bar", FEATURES, f"SELECT brand_detected, {measures(['count', 'mean', 'median'])} FROM laptops {TOP} 10")
add("brand_chart", FEATURES, f"""SELECT brand_detected AS brand, count, mean AS mean_price, median AS median_price
  FROM (SELECT brand_detected, {measures(["count", "mean", "median"])} FROM laptops {TOP} 8)""")


def bins(n: int) -> str:
    return FEATURES + f""", ends AS (SELECT min(price) AS a, max(price) AS z FROM laptops),
edges AS (SELECT i AS bin, a + i * ((z - a) / {n}) AS lo, CASE WHEN i + 1 = {n} THEN z ELSE a + (i + 1) * ((z - a) / {n}) END AS hi
  FROM ends, range({n}) AS g(i)),
h AS (SELECT bin, lo, hi, (SELECT count(*) FROM laptops WHERE price >= lo AND (price < hi OR (bin = {n - 1} AND price = hi))) AS count FROM edges)"""


LABEL = "format('{:,}', CAST(trunc(lo) AS BIGINT)) || '–' || format('{:,}', CAST(trunc(hi) AS BIGINT))"
add("price_histogram", bins(12), f"SELECT bin, {LABEL} AS label, count FROM h")
add("price_distribution", bins(12), f"""SELECT bin, {LABEL} AS label, {r("lo", 0)} AS min, {r("hi", 0)} AS max, count,
  {r("count / sum(count) OVER () * 100")} AS pourcentage FROM h""")
add("chart_distribution", bins(10), f"SELECT bin, {LABEL} || ' MAD' AS label, count, {r('lo')} AS min_price, {r('hi')} AS max_price FROM h")
add("gaming_groups", FEATURES, f"""SELECT CASE WHEN is_gaming THEN 'gaming' ELSE 'non_gaming' END AS "group",
  {measures(["count", "mean", "median", "min", "max"])} FROM laptops GROUP BY 1""")
add("rank_sums", FEATURES + """, ranked AS (SELECT is_gaming, count(*) OVER (PARTITION BY price) AS t,
  rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS rk FROM laptops)""",
    """SELECT CAST(count(*) FILTER (WHERE is_gaming) AS BIGINT) AS n1, CAST(count(*) FILTER (WHERE NOT is_gaming) AS BIGINT) AS n2,
  sum(CASE WHEN is_gaming THEN rk ELSE 0 END)::DOUBLE - count(*) FILTER (WHERE is_gaming) * (count(*) FILTER (WHERE is_gaming) + 1) / 2 AS u1,
  CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM ranked""")
# the normal tail by the series of erf with positive terms; beyond 6 it is 0 at six digits
add("mann_whitney", "RECURSIVE " + FEATURES + """, ranked AS (SELECT is_gaming, count(*) OVER (PARTITION BY price) AS t,
  rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS rk FROM laptops),
sums AS (SELECT CAST(count(*) FILTER (WHERE is_gaming) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT is_gaming) AS DOUBLE) AS n2,
  sum(CASE WHEN is_gaming THEN rk ELSE 0 END)::DOUBLE AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM ranked),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, n1 + n2 AS n FROM sums WHERE n1 >= 5 AND n2 >= 5),
z AS (SELECT u1, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) / sqrt(2e0) AS x FROM u),
terms AS (SELECT u1, x, 0 AS k, x AS term, x AS total FROM z
  UNION ALL SELECT u1, x, k + 1, term * 2 * x * x / (2 * k + 3), total + term * 2 * x * x / (2 * k + 3) FROM terms WHERE k < 250 AND abs(x) < 6),
p AS (SELECT u1, CASE WHEN x >= 6 THEN 0e0 ELSE least(1e0, 1 - 2 / sqrt(pi()) * exp(-x * x) * total) END AS p FROM terms
  QUALIFY row_number() OVER (ORDER BY k DESC) = 1)""",
    f"SELECT {r('u1', 4)} AS statistic, {r('p', 6)} AS pvalue, p < 0.05 AS significant FROM p")
CORR = ["price", "log_price", "ram_gb", "storage_gb", "cpu_score", "price_per_gb_ram"]


def spearman(a: str, b: str) -> str:
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return (f"(SELECT {r('corr(ra, rb)', 4)} FROM (SELECT {rank.format(a)} AS ra, {rank.format(b)} AS rb FROM laptops "
            f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL))")


CELLS = {frozenset(p): spearman(*p) for p in combinations(CORR, 2)}
add("correlation_matrix", FEATURES, " UNION ALL ".join(
    f"SELECT {quote(a)} AS feature, " + ", ".join(
        f"{'1e0' if a == b else CELLS[frozenset((a, b))]} AS {b}" for b in CORR) for a in CORR))
add("accessory_stats", ACC, f"""SELECT accessory_category AS category, {measures(["count", "mean", "median", "min", "max", "q1", "q3"])}
  FROM accessories GROUP BY 1""")
add("search_stats", f"p AS (SELECT search_id, CAST(price AS DOUBLE) AS price FROM ({PRICES_SQL}))",
    f"""SELECT search_id, {r("min(price)")} AS min_price, {r("max(price)")} AS max_price, {r("avg(price)")} AS mean_price,
  {r(q(0.5))} AS median_price, {r("stddev_samp(price)")} AS std_price, {r(q(0.25))} AS q1, {r(q(0.75))} AS q3, count(*) AS count
  FROM p GROUP BY 1 HAVING count(*) >= 2""")
# brute force over all pairs of distinct vectors
VECTOR_LABELS = ["cluster_id", "gaming_id", "gpu_id"]
_columns = {"x0": "price_step", "x1": "ram_gb", "x2": "cpu"}
QUALITY = BANDED + f""", raw AS (SELECT {r("log_price")} AS price_step, CAST(ram_gb AS DOUBLE) AS ram_gb, nullif(cpu_score, 0) AS cpu, cluster_id,
    CAST(is_gaming AS INT) AS gaming_id, CAST(has_gpu AS INT) * 2 + CAST(is_tactile AS INT) AS gpu_id FROM banded),
filled AS (SELECT {", ".join(f"coalesce({c}, (SELECT median({c}) FROM raw), 0) AS {c}" for c in _columns.values())}, {", ".join(VECTOR_LABELS)} FROM raw),
marks AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS {c}_m, coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1) AS {c}_w" for c in _columns.values())} FROM filled),
vec AS (SELECT row_number() OVER () AS i, * FROM (SELECT {", ".join(f"({c} - {c}_m) / {c}_w AS {x}" for x, c in _columns.items())}, {", ".join(VECTOR_LABELS)}, count(*) AS c
  FROM filled, marks GROUP BY ALL)),
long AS ({" UNION ALL ".join(f"SELECT '{c}' AS labelling, i, x0, x1, x2, {c} AS y, c FROM vec" for c in VECTOR_LABELS)}),
sizes AS (SELECT labelling, y, sum(c) AS n, sum(c * x0) / sum(c) AS m0, sum(c * x1) / sum(c) AS m1, sum(c * x2) / sum(c) AS m2 FROM long GROUP BY ALL),
near AS (SELECT a.i, b.labelling, b.y, sum(b.c * sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2)) AS d FROM vec a, long b GROUP BY ALL),
per AS (SELECT l.labelling, l.i, any_value(l.c) AS c, max(CASE WHEN near.y = l.y THEN n END) AS own, max(CASE WHEN near.y = l.y THEN d / nullif(n - 1, 0) END) AS a,
    min(CASE WHEN near.y <> l.y THEN d / n END) AS b
  FROM long l JOIN near ON near.i = l.i AND near.labelling = l.labelling JOIN sizes s ON s.labelling = l.labelling AND s.y = near.y GROUP BY 1, 2),
sil AS (SELECT labelling, sum(c * CASE WHEN own > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) / sum(c) AS silhouette FROM per GROUP BY 1),
spread AS (SELECT labelling, y, m0, m1, m2, n, (SELECT sum(c * sqrt((x0 - m0) ** 2 + (x1 - m1) ** 2 + (x2 - m2) ** 2)) / sum(c) FROM long WHERE long.labelling = sizes.labelling AND long.y = sizes.y) AS s FROM sizes),
db AS (SELECT labelling, sum(w) / count(*) AS davies_bouldin FROM (SELECT a.labelling, a.y,
    coalesce(max(CASE WHEN a.y <> b.y THEN (a.s + b.s) / nullif(sqrt((a.m0 - b.m0) ** 2 + (a.m1 - b.m1) ** 2 + (a.m2 - b.m2) ** 2), 0) END), 0) AS w
  FROM spread a JOIN spread b USING (labelling) GROUP BY 1, 2) GROUP BY 1)"""
_near = ["f0", "f1", "f2", "f3"]
_raw = {"f0": r("log_price"), "f1": "CAST(ram_gb AS DOUBLE)", "f2": "CAST(storage_gb AS DOUBLE)", "f3": "CAST(cpu_score AS DOUBLE)"}
LOF = FEATURES + f""", raw AS (SELECT id, link, price, {", ".join(f"{v} AS {n}" for n, v in _raw.items())} FROM laptops),
filled AS (SELECT id, link, price, {", ".join(f"coalesce({n}, (SELECT median({n}) FROM raw), 0) AS {n}" for n in _near)} FROM raw),
marks AS (SELECT {", ".join(f"median({n}) AS {n}_m, coalesce(nullif(quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25), 0), 1) AS {n}_w" for n in _near)} FROM filled),
pts AS (SELECT id, link, price, {", ".join(f"({n} - {n}_m) / {n}_w + 0e0 AS {n}" for n in _near)} FROM filled, marks),
vec AS (SELECT row_number() OVER () AS i, * FROM (SELECT {", ".join(_near)}, count(*) AS c FROM pts GROUP BY ALL)),
k AS (SELECT greatest(5, least(20, (SELECT count(*) FROM pts) // 10)) AS k),
pairs AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN b.c - 1 ELSE b.c END AS free, {", ".join(f"b.{n}" for n in _near)},
    round(sqrt({" + ".join(f"(a.{n} - b.{n}) ** 2" for n in _near)}), 10) AS d FROM vec a, vec b WHERE a.i <> b.i OR b.c > 1),
near AS (SELECT i, j, d, least(free, k - before) AS copies FROM (SELECT *, coalesce(sum(free) OVER (PARTITION BY i ORDER BY d, {", ".join(_near)}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pairs QUALIFY before < 20), k WHERE before < k),
kd AS (SELECT i, max(d) AS kd FROM near GROUP BY 1),
lrd AS (SELECT near.i, 1 / (sum(copies * greatest(kd, d)) / sum(copies) + 1e-10) AS lrd FROM near JOIN kd ON kd.i = near.j GROUP BY 1),
lof AS (SELECT near.i, sum(copies * b.lrd) / sum(copies) / any_value(a.lrd) AS lof FROM near JOIN lrd a ON a.i = near.i JOIN lrd b ON b.i = near.j GROUP BY 1),
scored AS (SELECT id, link, price, lof FROM pts JOIN vec USING ({", ".join(_near)}) JOIN lof USING (i))"""
add("local_outlier_factor_steps", LOF, f"""SELECT id, link, price, -lof < (SELECT quantile_cont(-lof, 0.05) FROM scored) AS anomaly_lof,
  {r("lof", 4)} AS anomaly_lof_score FROM scored""")
add("band_vector_quality", QUALITY, f"""SELECT labelling, CAST(count(*) AS INT) AS clusters, CAST(sum(n) AS BIGINT) AS rows, CAST(min(n) AS BIGINT) AS smallest,
  {r("any_value(silhouette)", 4)} AS silhouette, {r("any_value(davies_bouldin)", 4)} AS davies_bouldin
  FROM sizes JOIN sil USING (labelling) JOIN db USING (labelling) GROUP BY 1""")
# every pair of cuts of a search's sorted prices, and expected depths by pairs of its prices
SEARCH_VALUES = f"""v0 AS (SELECT search_id, CAST(price AS DOUBLE) AS price, count(*) AS c FROM ({PRICES_SQL}) GROUP BY ALL),
t0 AS (SELECT search_id, sum(c) AS n, count(*) AS m, sum(price * c) / sum(c) AS mean FROM v0 GROUP BY 1 HAVING sum(c) >= 2),
t1 AS (SELECT search_id, any_value(n) AS n, any_value(m) AS m, any_value(mean) AS mean,
  sqrt(sum(c * (price - mean) * (price - mean)) / sum(c)) AS sd FROM v0 JOIN t0 USING (search_id) GROUP BY 1),
v AS (SELECT search_id, price, c, n, m, mean, sd, row_number() OVER w AS i, lag(price) OVER w AS below, lead(price) OVER w AS above,
  sum(c) OVER w AS s0, sum(c * (price - mean) / nullif(sd, 0)) OVER w AS s1, sum(c * ((price - mean) / nullif(sd, 0)) ** 2) OVER w AS s2
  FROM v0 JOIN t1 USING (search_id) WINDOW w AS (PARTITION BY search_id ORDER BY price))"""
SEARCH_CUTS = SEARCH_VALUES + """, cuts AS (SELECT a.search_id, min_by((a.i, b.i), (round((
    a.s2 - a.s1 * a.s1 / a.s0 + b.s2 - a.s2 - (b.s1 - a.s1) ** 2 / (b.s0 - a.s0) + z.s2 - b.s2 - (z.s1 - b.s1) ** 2 / (z.s0 - b.s0)
    ) / a.n * 1e9), a.i, b.i)) AS cut
  FROM v a JOIN v b ON a.search_id = b.search_id AND a.i < b.i JOIN v z ON z.search_id = a.search_id AND z.i = z.m AND b.i < z.i GROUP BY 1),
placed AS (SELECT v.*, CASE WHEN cut IS NULL THEN i - 1 WHEN i <= cut[1] THEN 0 WHEN i <= cut[2] THEN 1 ELSE 2 END::INT AS cluster_id
  FROM v LEFT JOIN cuts USING (search_id) WHERE n >= 3),
clusters AS (SELECT search_id, cluster_id, (['Économique', 'Intermédiaire', 'Premium'])[cluster_id + 1] AS name,
  (sum(price * c) / sum(c) - any_value(mean)) / CASE WHEN any_value(sd) > 0 THEN any_value(sd) ELSE 1 END AS center,
  sum(price * c) / sum(c) AS mean_price, min(price) AS lowest, max(price) AS highest, sum(c) AS rows FROM placed GROUP BY 1, 2)"""


def mean_path(x: str) -> str:
    return f"CASE WHEN {x} <= 1 THEN 0 WHEN {x} <= 2 THEN 1 ELSE 2 * (ln(greatest({x}, 3) - 1) + 0.5772156649015329) - 2 * ({x} - 1e0) / {x} END"


SEARCH_FLAGS = SEARCH_VALUES + f""", depths AS (SELECT a.search_id, a.price, any_value(a.c) AS c, any_value(a.n) AS n,
    sum(CASE WHEN b.price > a.price THEN (b.price - b.below) / (b.price - a.price) WHEN b.price < a.price THEN (b.above - b.price) / (a.price - b.price)
      ELSE 0 END) + {mean_path("any_value(a.c)")} AS depth
  FROM v a JOIN v b USING (search_id) WHERE a.n >= 5 GROUP BY 1, 2),
scores AS (SELECT *, -round(2 ** (-depth / ({mean_path("n")})), 9) AS score FROM depths),
cut AS (SELECT search_id, quantile_cont(score, 0.05) AS cut FROM (SELECT search_id, score, unnest(range(c)) FROM scores) GROUP BY 1),
flags AS (SELECT search_id, price AS p, score FROM scores JOIN cut USING (search_id) WHERE score < cut)"""
add("search_clusters", SEARCH_CUTS, f"""SELECT search_id, cluster_id, name, {r("center", 6)} AS center, {r("mean_price")} AS mean_price,
  lowest, highest, CAST(rows AS BIGINT) AS rows FROM clusters""")
add("search_flagged", SEARCH_FLAGS + f", prices AS ({PRICES_SQL}), products AS ({PRODUCTS_SQL})", f"""SELECT search_id, product_id, title, platform,
  price, {r("score", 4)} AS score FROM prices JOIN products USING (product_id) JOIN flags USING (search_id) WHERE CAST(price AS DOUBLE) = p""")
add("search_reports", SEARCH_CUTS + SEARCH_FLAGS.removeprefix(SEARCH_VALUES) + f""", s AS (SELECT search_id,
    max(center) FILTER (WHERE cluster_id = 0) AS c0, max(center) FILTER (WHERE cluster_id = 1) AS c1, max(center) FILTER (WHERE cluster_id = 2) AS c2,
    string_agg(name, ', ' ORDER BY cluster_id) AS names FROM clusters GROUP BY 1),
a AS (SELECT v.search_id, sum(c) AS k FROM flags JOIN v ON flags.search_id = v.search_id AND p = v.price GROUP BY 1)""",
    f"""SELECT search_id, CAST(t1.n AS BIGINT) AS count, {r("c0", 6)} AS center_0, {r("c1", 6)} AS center_1, {r("c2", 6)} AS center_2,
  coalesce(names, '') AS cluster_names, CAST(coalesce(k, 0) AS BIGINT) AS anomaly_count FROM t1 LEFT JOIN s USING (search_id) LEFT JOIN a USING (search_id)""")
add("platform_distribution", FEATURES, f"""SELECT source AS platform, count(price) AS count, {r("avg(price)")} AS mean,
  min(price) AS min, max(price) AS max FROM laptops GROUP BY 1""")
add("run_summary", f"offers AS ({OFFERS_SQL})", """SELECT search_query, count(*) FILTER (WHERE source = 'Jumia') AS jumia_count,
  count(*) FILTER (WHERE source = 'Amazon') AS amazon_count, count(*) FILTER (WHERE source = 'AliExpress') AS aliexpress_count,
  count(*) AS total_scraped, count(*) AS inserted, 'success' AS status FROM offers GROUP BY 1""")
add("feature_coverage", FEATURES, f"""SELECT count(*) AS rows, count(ram_gb) AS ram_known, {r("count(ram_gb) / count(*) * 100", 0)} AS ram_pct,
  count(storage_gb) AS storage_known, {r("count(storage_gb) / count(*) * 100", 0)} AS storage_pct FROM laptops""")
add("currency_audit", f"offers AS ({OFFERS_SQL})", """SELECT count(*) FILTER (WHERE currency = 'USD') AS usd,
  count(*) FILTER (WHERE currency = 'MAD') AS mad, count(*) FILTER (WHERE currency NOT IN ('USD', 'MAD', 'EUR')) AS other FROM offers""")
add("category_counts", FEATURES, "SELECT price_category, count(*) AS count FROM laptops WHERE price_category <> '' GROUP BY 1")
Z = ", z AS (SELECT *, abs((ln(1 + price) - m) / s) AS z, med FROM {0}, (SELECT avg(ln(1 + price)) AS m, stddev_pop(ln(1 + price)) AS s, quantile_cont(price, 0.5) AS med FROM {0}))"
BANDS = " UNION ALL ".join(
    f"SELECT {i} AS band, {quote(n)} AS label, (SELECT count(*) FROM u WHERE price >= {a} AND price < {'1e308' if z == float('inf') else z}) AS count"
    for i, (n, a, z) in enumerate(dims.ANOMALY_BANDS))
add("anomaly_bands", FEATURES + Z.format("laptops") + """, u AS (SELECT * FROM z WHERE z > 3 QUALIFY row_number() OVER (
  PARTITION BY left(title, 60), price ORDER BY id, title, price, link) = 1)""", BANDS)
add("anomaly_list", FEATURES + Z.format("laptops") + """, u AS (SELECT * FROM z WHERE z > 3 QUALIFY row_number() OVER (
  PARTITION BY left(title, 60), price ORDER BY id, title, price, link) = 1)""",
    "SELECT id, title, price, link, price_category FROM u WHERE price_category = 'entrée_de_gamme'")
add("dashboard", FEATURES + Z.format("laptops"), f"""SELECT count(price) AS offers, {r(q(0.5))} AS median_price,
  count(DISTINCT brand_detected) AS brands, count(*) FILTER (WHERE z > 3) AS anomalies FROM z""")


def axis(c: str) -> str:
    return (f"CASE WHEN max({c}) OVER () > 0 THEN CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 0.5e0 ELSE "
            f"CAST({c} - min({c}) OVER () AS DOUBLE) / (max({c}) OVER () - min({c}) OVER ()) END END AS {c}_axis")


add("radar", BANDED + f", t AS (SELECT cluster, {measures(['count', 'mean', 'median'])} FROM banded GROUP BY 1)",
    f"SELECT cluster, CAST(floor(count / sum(count) OVER () * 100 + 0.5) AS BIGINT) AS share_pct, {axis('median')}, {axis('count')}, {axis('mean')} FROM t")
add("row_counts", FEATURES, "SELECT count(*) AS rows FROM laptops")

# --- scaling, segments, anomalies
FILLED = FEATURES + """, med AS (SELECT quantile_cont(price, 0.5) AS mp, quantile_cont(ram_gb, 0.5) AS mr FROM laptops),
x AS (SELECT id, link, price, ram_gb, coalesce(price, mp) AS p, CAST(coalesce(ram_gb, mr) AS DOUBLE) AS g FROM laptops, med)"""


def scaler(origin: str, width: str) -> str:
    o, w = origin, width
    return FILLED + f", k AS (SELECT {o.format('p')} AS op, {w.format('p')} AS wp, {o.format('g')} AS og, {w.format('g')} AS wg FROM x)"


SCALED = f"""SELECT id, link, price, ram_gb, {r("(p - op) / CASE WHEN wp = 0 THEN 1 ELSE wp END", 6)} AS price_scaled,
  {r("(g - og) / CASE WHEN wg = 0 THEN 1 ELSE wg END", 6)} AS ram_gb_scaled FROM x, k"""
add("scaled_minmax", scaler("min({})", "max({0}) - min({0})"), SCALED)
add("scaled_standard", scaler("avg({})", "stddev_pop({})"), SCALED)
add("scaled_robust", scaler("quantile_cont({}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"), SCALED)
add("normalized_prices", FEATURES, f"""SELECT id, link, price, {r("(price - a) / (z - a)", 6)} AS price_normalized
  FROM laptops, (SELECT min(price) AS a, max(price) AS z FROM laptops)""")
add("price_bands", BANDED, "SELECT id, link, price, cluster_id, cluster FROM banded")
add("band_table", BANDED, f"SELECT cluster, {measures(['count', 'mean', 'median', 'min', 'max'])} FROM banded GROUP BY 1")
add("band_summary", BANDED + """, b AS (SELECT cluster, brand_detected AS top_brand FROM banded WHERE brand_detected IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, brand_detected) = 1)""", f"""SELECT s.*, top_brand FROM (SELECT cluster,
  {measures(["count", "mean", "median", "min", "max", "std"])}, {r("avg(CAST(is_gaming AS INT)) * 100", 1)} AS gaming_pct,
  {r("avg(cpu_score)", 1)} AS avg_cpu_score, {r("avg(ram_gb)", 1)} AS avg_ram_gb FROM banded GROUP BY 1) s LEFT JOIN b USING (cluster)""")
NAMES = " ".join(f"WHEN {i + 1} THEN {quote(n)}" for i, n in enumerate(dims.SEGMENT_NAMES))
add("cluster_names", FEATURES + """, c AS (SELECT id, link, price, CAST(id % 7 - 1 AS INT) AS cluster_id FROM laptops),
n AS (SELECT cluster_id, row_number() OVER (ORDER BY quantile_cont(price, 0.5), cluster_id) AS place FROM c WHERE cluster_id <> -1 GROUP BY 1)""",
    f"""SELECT id, link, price, cluster_id, CASE WHEN cluster_id = -1 THEN 'Bruit/Outlier' ELSE
  CASE place {NAMES} ELSE 'Cluster ' || place END END AS cluster FROM c LEFT JOIN n USING (cluster_id)""")
add("band_quality", BANDED + """, pts AS (SELECT cluster_id, log_price AS v FROM banded),
m AS (SELECT cluster_id, avg(v) AS mean, count(*) AS n, sum(v) AS total FROM pts GROUP BY 1),
o AS (SELECT cluster_id, v, count(*) OVER w AS k, sum(v) OVER w AS below FROM pts WINDOW w AS (PARTITION BY cluster_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
ab AS (SELECT o.cluster_id, (v * k - below + (total - below) - v * (n - k)) / (n - 1) AS a, n,
  (SELECT min(abs(m2.mean - v)) FROM m m2 WHERE m2.cluster_id <> o.cluster_id) AS b FROM o JOIN m USING (cluster_id))""",
    f"""SELECT 0.1003e0 AS eps, 3 AS min_samples, count(DISTINCT cluster_id) AS n_clusters, 0 AS n_outliers,
  {r("avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)", 4)} AS silhouette FROM ab""")
IQR = ", fence AS (SELECT q1 - 0.7e0 * (q3 - q1) AS low, q3 + 0.7e0 * (q3 - q1) AS high FROM (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM laptops))"
add("detect_iqr", FEATURES + IQR, """SELECT id, link, price, NOT (price BETWEEN low AND high) AS anomaly_iqr,
  CASE WHEN price < low THEN 'trop_bas' WHEN price > high THEN 'trop_haut' ELSE 'normal' END AS anomaly_iqr_type FROM laptops, fence""")
add("detect_zscore", FEATURES + Z.format("laptops"), f"""SELECT id, link, price, z > 3 AS anomaly_zscore, {r("z", 4)} AS zscore_value,
  CASE WHEN z > 3 AND price < med THEN 'trop_bas' WHEN z > 3 AND price > med THEN 'trop_haut' ELSE 'normal' END AS anomaly_zscore_type FROM z""")
CTX = """, ctx AS (SELECT cluster, q1 - 0.7e0 * (q3 - q1) AS clow, q3 + 0.7e0 * (q3 - q1) AS chigh FROM (SELECT cluster,
  quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM banded GROUP BY 1 HAVING count(*) >= 10))"""
add("detect_contextual", BANDED + CTX, """SELECT id, link, price, b.cluster, coalesce(NOT (price BETWEEN clow AND chigh), false) AS anomaly_contextual
  FROM banded b LEFT JOIN ctx USING (cluster)""")
add("anomaly_summary", BANDED + CTX + IQR + Z.format("banded") + """, flags AS (SELECT count(*) FILTER (WHERE NOT price BETWEEN low AND high) AS i,
  count(*) FILTER (WHERE z > 3) AS zz, count(*) FILTER (WHERE NOT price BETWEEN clow AND chigh) AS c, count(*) AS n
  FROM z LEFT JOIN ctx USING (cluster), fence)""", " UNION ALL ".join(
    f"SELECT {quote(n)} AS methode, {c} AS anomalies, {r(f'{c} / n * 100')} AS pourcentage FROM flags"
    for n, c in [("IQR", "i"), ("Z-score", "zz"), ("Contextuel", "c")]))
add("anomalies_by_price", FEATURES + Z.format("laptops"), "SELECT id, link, price FROM z WHERE z > 3")
add("chart_anomalies", FEATURES + Z.format("laptops"), "SELECT title, price, brand_detected FROM z WHERE z > 3 ORDER BY price, title, brand_detected LIMIT 100")
add("explained_anomalies", BANDED + Z.format("banded") + """, cm AS (SELECT cluster, quantile_cont(price, 0.5) AS cmed FROM banded GROUP BY 1),
e AS (SELECT *, price / cmed AS ratio FROM z JOIN cm USING (cluster) WHERE z > 3)""", f"""SELECT left(title, 80) AS title, {r("price")} AS price, brand_detected,
  price_category, cluster, {r("cmed")} AS cluster_median, CASE WHEN ratio < 0.5 THEN 'trop_bas' WHEN ratio > 2 THEN 'trop_haut' ELSE 'suspect' END AS anomaly_type,
  CASE WHEN ratio < 0.5 THEN 'Prix ' || CAST({r("(1 - ratio) * 100", 0)} AS BIGINT) || '% sous la médiane du cluster'
  WHEN ratio > 2 THEN 'Prix ' || CAST({r("(ratio - 1) * 100", 0)} AS BIGINT) || '% au-dessus de la médiane du cluster'
  ELSE 'Combinaison prix/specs inhabituelle' END AS reason, source
  FROM e ORDER BY price, title, brand_detected, price_category, cluster, cluster_median, anomaly_type, reason, source LIMIT 100""")


# --- samples
def digest(seed: int) -> str:
    return f"md5('{seed}|' || link || '|' || title || '|' || CAST(price AS VARCHAR) || '|' || source)"


add("scatter_sample", BANDED, f"""SELECT left(title, 60) AS title, price, cluster, brand_detected AS brand, is_gaming AS gaming
  FROM banded ORDER BY {digest(42)} LIMIT 300""")
add("random_offers", FEATURES, f"SELECT id, link, title, price, source FROM laptops WHERE price > 0 ORDER BY {digest(7)} LIMIT 20")
add("first_rows", BANDED, "SELECT title, price, cluster, brand_detected, is_gaming, cluster_id FROM banded ORDER BY id DESC, link DESC LIMIT 500")
for _name in ("crawl_dedup_check", "crawl_dedup_runs_check"):
    add(_name, f"offers AS ({OFFERS_SQL})",
        "SELECT count(*) AS offers, 0 AS shared_links, 0 AS shared_titles, 0 AS unexplained FROM offers")
add("every_nth", FEATURES, """SELECT id, link, price FROM laptops QUALIFY (row_number() OVER (ORDER BY id, link, price) - 1)
  % CAST(ceil(count(*) OVER () / 500.0) AS BIGINT) = 0""")


# --- association rules
def mined(items: dict[str, str], table: str, support: float, confidence: float, lift: float, sizes: tuple[int, ...] = (1, 2, 3)) -> str:
    """Itemsets and rules over the given item expressions, every split of every set."""
    names = list(items)
    cells = ", ".join(f"{x} AS i{n}" for n, x in enumerate(items.values()))
    sets = [c for size in sizes for c in combinations(range(len(names)), size)]
    union = " UNION ALL ".join(
        f"SELECT list_sort([{', '.join(f'i{i}' for i in c)}]) AS items FROM cells WHERE {' AND '.join(f'i{i} IS NOT NULL' for i in c)}"
        for c in sets)
    return f"""cells AS (SELECT {cells} FROM {table}),
total AS (SELECT count(*) AS n FROM cells WHERE coalesce({', '.join(f'i{i}' for i in range(len(names)))}) IS NOT NULL),
fr AS (SELECT items, count(*) / n AS support FROM ({union}), total GROUP BY items, n HAVING count(*) / n >= {support}e0),
pairs AS (SELECT w.support AS support, a.items AS a, b.items AS b, w.support / a.support AS confidence, b.support AS sb FROM fr w
  JOIN fr a ON len(a.items) < len(w.items) AND list_has_all(w.items, a.items)
  JOIN fr b ON b.items = list_filter(w.items, lambda x: NOT list_contains(a.items, x))),
rules AS (SELECT DISTINCT array_to_string(a, ', ') AS antecedent, array_to_string(b, ', ') AS consequent, {r("support", 4)} AS support,
  {r("confidence", 4)} AS confidence, {r("confidence / sb", 4)} AS lift FROM pairs WHERE confidence >= {confidence}e0 AND confidence / sb >= {lift}e0)"""


LAP_ITEMS = {
    "brand_detected": "'brand_detected=' || brand_detected", "price_category": "'price_category=' || price_category",
    "is_gaming": "'is_gaming=is_gaming=' || CASE WHEN is_gaming THEN 'Oui' ELSE 'Non' END",
    "has_gpu": "'has_gpu=has_gpu=' || CASE WHEN has_gpu THEN 'Oui' ELSE 'Non' END", "cluster": "'cluster=' || cluster",
}
LAP_RULES = BANDED + ", " + mined(LAP_ITEMS, "banded", 0.08, 0.6, 1.2)
add("frequent_itemsets", LAP_RULES, f"SELECT array_to_string(items, ', ') AS itemset, {r('support', 6)} AS support FROM fr")
FOUR = BANDED + ", " + mined(LAP_ITEMS | {"t": "'storage_type=' || storage_type", "s": "'source=' || source"}, "banded", 0.05, 0.6, 1.2, (1, 2, 3, 4))
add("frequent_itemsets_of_four", FOUR, f"SELECT array_to_string(items, ', ') AS itemset, {r('support', 6)} AS support FROM fr")
add("laptop_rules", LAP_RULES, "SELECT * FROM rules")
ACC_ITEMS = {
    "c": "'accessory_category=' || accessory_category", "s": "'source=' || source", "p": "'price_range=' || price_range",
    "g": "'is_gaming_str=gaming=' || CASE WHEN is_gaming THEN 'Oui' ELSE 'Non' END",
}
add("accessory_rules", ACC + ", " + mined(ACC_ITEMS, "accessories", 0.05, 0.5, 1.0), "SELECT * FROM rules")
X_ITEMS = {
    "a": "'laptop_price_category=' || price_category", "b": "'laptop_brand_detected=' || brand_detected",
    "c": "'laptop_is_gaming=' || CASE WHEN lg THEN 'True' ELSE 'False' END", "d": "'acc_accessory_category=' || accessory_category",
    "e": "'acc_price_range=' || price_range",
}
PAIRED = f""", la AS (SELECT price_category, brand_detected, is_gaming AS lg, row_number() OVER (ORDER BY {digest(42)}, link, title, price, source) AS k FROM laptops),
ac AS (SELECT accessory_category, price_range, row_number() OVER (ORDER BY {digest(42)}, link, title, price, source) AS k FROM accessories),
paired AS (SELECT * FROM la JOIN ac USING (k))"""
add("cross_rules", FEATURES + ", " + ACC + PAIRED + ", " + mined(X_ITEMS, "paired", 0.05, 0.4, 1.0), "SELECT * FROM rules")
BEST = "ORDER BY {} DESC, antecedent, consequent LIMIT {}"
add("rules_by_consequent", LAP_RULES, f"SELECT * FROM rules WHERE regexp_matches(consequent, '(?i)GPU') {BEST.format('lift', 10)}")
add("best_rules", LAP_RULES, f"SELECT * FROM rules {BEST.format('lift', 20)}")


def label(c: str) -> str:
    for old, new in [("is_gaming=is_gaming=", "gaming="), ("has_gpu=has_gpu=", "gpu="), ("brand_detected=", "marque="),
                     ("price_category=", "gamme="), ("accessory_category=", "cat="), ("price_range=", "prix="), ("source=", "src="), ("_", " ")]:
        c = f"replace({c}, '{old}', '{new}')"
    return c


add("find_rules", LAP_RULES, f"""SELECT * FROM rules WHERE contains(lower({label("antecedent")}), 'gaming=oui')
  OR contains(lower({label("consequent")}), 'gaming=oui') {BEST.format('confidence', 40)}""")
add("rule_labels", LAP_RULES, f"SELECT {label('antecedent')} AS a, {label('consequent')} AS c, lift FROM rules")

# --- pages, terms, snapshots
CARD = f"offers AS ({OFFERS_SQL}), c AS (SELECT *, regexp_extract(link, '[^/]*$') AS leaf, trim(title) AS name FROM offers)"
WORD = "regexp_extract(name, '\\S+') AS brand"
add("jumia_cards", CARD, f"""SELECT name AS title, CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT) AS price, {WORD}, source,
  'https://www.jumia.ma/item/' || leaf AS link, 'i.jpg' AS image, contains(lower(name), 'gaming') AS is_gaming FROM c WHERE source = 'Jumia'""")
for family, category in dims.LISTING_CATEGORIES.items():
    wanted, unwanted, lowest = dims.LISTING_RULES[family]
    yes, no = (" OR ".join(f"strpos(lower(name), {quote(w)}) > 0" for w in words) for words in (wanted, unwanted))
    extra = {"mouse": ", CAST(NULL AS BIGINT) AS old_price, CAST(NULL AS VARCHAR) AS discount, md5('https://www.jumia.ma/item/' || leaf) AS product_id"}
    gaming = "" if family in ("usb", "cooling") else ", regexp_matches(lower(name), 'gaming|gamer') AS is_gaming"
    add(f"jumia_{family}_listing", CARD.replace(OFFERS_SQL, BAGS_SQL) if family == "bag" else CARD, f"""SELECT name AS title, CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT) AS price, {WORD},
  source, 'https://www.jumia.ma/item/' || leaf AS link, 'i.jpg' AS image, {quote(category)} AS category, true AS in_stock
  {gaming}{extra.get(family, ", 'MAD' AS currency")} FROM c WHERE source = 'Jumia' AND ({yes}) AND NOT ({no or "false"})
  AND CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT) >= {lowest}""")
add("jumia_crawl_check", "", f"""SELECT count(*) AS offers, 0 AS shared_links, 0 AS shared_titles, 0 AS unexplained
  FROM ({ORACLES["jumia_mouse_listing"]})""")
add("amazon_cards", CARD, f"""SELECT name AS title, regexp_replace(price, '[^0-9,.]', '', 'g') AS price,
  CASE WHEN contains(price, 'MAD') THEN 'MAD' ELSE '€' END AS currency, {WORD}, source, 'https://www.amazon.fr/item/' || leaf AS link,
  'i.jpg' AS image, contains(lower(name), 'gaming') AS is_gaming FROM c WHERE source = 'Amazon'""")
add("amazon_accessory_cards", CARD, f"""SELECT name AS title,
  coalesce({r("TRY_CAST(replace(regexp_replace(price, '[^0-9,.]', '', 'g'), ',', '.') AS DOUBLE)")}, 0e0) AS price, 'EUR' AS currency, {WORD},
  source, 'https://www.amazon.fr/item/' || leaf AS link, 'i.jpg' AS image,
  regexp_matches(lower(name), 'gaming|gamer|rog|alienware') AS is_gaming, 'sac_laptop' AS category, true AS in_stock FROM c WHERE source = 'Amazon'""")
add("aliexpress_cards", MAD + ", c AS (SELECT *, regexp_extract(link, '[^/]*$') AS leaf, trim(title) AS name FROM num)", f"""SELECT name AS title,
  coalesce(free, 0e0) AS price, 'MAD' AS currency, {WORD}, source, 'https://fr.example/item/' || leaf AS link, 'https://i.jpg' AS image,
  contains(lower(name), 'gaming') AS is_gaming FROM c WHERE source = 'AliExpress'""")
KNOWN = " UNION ALL ".join(
    f"SELECT {quote(s)} AS shop, {quote(seed)} AS seed, {quote(t)} AS term" for (s, seed), ts in dims.SEARCH_TERMS.items() for t in ts)
add("expand_terms", f"offers AS ({OFFERS_SQL}), known AS ({KNOWN}), seeds AS (SELECT DISTINCT source AS shop, search_query AS seed FROM offers)",
    "SELECT shop, s.seed, coalesce(term, s.seed) AS term FROM seeds s LEFT JOIN known k USING (shop, seed)")
add("neighbour_eps", FEATURES + """, m AS (SELECT median(log_price) AS m, coalesce(nullif(quantile_cont(log_price, 0.75) - quantile_cont(log_price, 0.25), 0), 1) AS w FROM laptops),
x AS (SELECT (log_price - m) / w AS x FROM laptops, m),
d AS (SELECT """ + "least(" + ", ".join(
        f"greatest(coalesce(x - lag(x, {a}) OVER o, 1e9), coalesce(lead(x, {4 - a}) OVER o - x, 1e9))" for a in range(5)) + """) AS d FROM x WINDOW o AS (ORDER BY x))""",
    "SELECT round(quantile_cont(d, 0.999), 9) AS eps FROM d")
add("usable_features", FEATURES, """SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS place, f AS feature FROM (
  SELECT 0 AS o, 'log_price' AS f, 1 AS share UNION ALL SELECT 1, 'ram_gb', avg(CAST(ram_gb IS NOT NULL AS INT)) FROM laptops
  UNION ALL SELECT 2, 'storage_gb', avg(CAST(storage_gb IS NOT NULL AS INT)) FROM laptops
  UNION ALL SELECT 3, 'cpu_generation', avg(CAST(cpu_generation IS NOT NULL AS INT)) FROM laptops
  UNION ALL SELECT 4, 'rare', avg(CAST(id % 9 = 0 AS INT)) FROM laptops) WHERE share >= 0.2""")
add("truth_flags", f"offers AS ({OFFERS_SQL})", "SELECT id, id % 8 IN (0, 1, 2, 5) AS flag FROM offers")
add("crawl_export", f"offers AS ({OFFERS_SQL})", "SELECT id, title, price, currency, source, link, page FROM offers")
add("accessories_preferred", f"acc AS ({ACCESSORIES_SQL})", f"""SELECT origin, category, count(*) AS rows, {r("sum(CAST(price AS DOUBLE))")} AS total
  FROM (SELECT 'csv' AS origin, category, price FROM acc WHERE in_stock UNION ALL SELECT 'table', category, price FROM acc) GROUP BY 1, 2""")
add("kmeans_check", FEATURES, f"SELECT count(*) AS rows, 5 AS segments, 0 AS meeting, {quote(', '.join(dims.SEGMENT_NAMES))} AS names FROM laptops")
add("forest_check", FEATURES, "SELECT count(*) AS rows, true AS share_holds, true AS scores_hold, true AS flagged_lie_below FROM laptops")
add("pca_check", FEATURES, "SELECT count(*) AS rows, true AS centred, true AS uncorrelated, true AS ordered FROM laptops")
add("snapshot_rows", FEATURES, """SELECT 'by_source' AS cache_key, '{"source":"' || source || '","count":' || count(*) || '}' AS result,
  (SELECT count(*) FROM laptops) AS products_count, true AS is_valid FROM laptops GROUP BY source""")
add("merge_feeds", f"offers AS ({OFFERS_SQL})", "SELECT id, link, source, CASE WHEN source <> 'Jumia' THEN currency END AS currency FROM offers")
