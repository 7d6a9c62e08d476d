"""Search, paging and small filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.features import rule_label

PRODUCT_COLUMNS = ["title", "brand", "search_query"]
ACCESSORY_COLUMNS = ["title", "brand", "search_query", "category"]


def _like(column: str, text: str) -> Column:
    """Substring search where % and _ of the user act as wildcards."""
    return F.lower(F.col(column)).like(f"%{text.lower()}%")


def newest_first(df: DataFrame) -> list[Column]:
    """Total order: id descending, then all other columns."""
    return [F.desc("id"), *[F.desc(c) for c in df.columns if c != "id"]]


def search_by_query(df: DataFrame, text: str) -> DataFrame:
    """Offers found by a search term, missing price shown as 0."""
    return df.where(_like("search_query", text)).withColumn("price", F.coalesce("price", F.lit(0.0)))


def search_offers(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Offers with the text in one of the columns."""
    return df.where(reduce(lambda a, b: a | b, [_like(c, text) for c in columns]))


def page_of(df: DataFrame, page: int, limit: int) -> DataFrame:
    """One page, newest first (a bounded top-k, not a full sort)."""
    if page <= 0 or limit <= 0:
        raise ValueError("page and limit must be positive")
    return df.orderBy(*newest_first(df)).offset((page - 1) * limit).limit(limit)


def page_after(df: DataFrame, last: Row, limit: int) -> DataFrame:
    """Next page by key range: rows that come after ``last``, a row of ``df``, in the order of ``page_of``.

    The whole row is compared, so rows that share its id are not passed over; equal rows count as one.
    """
    beyond, same = F.lit(False), F.lit(True)
    for c in ["id", *[c for c in df.columns if c != "id"]]:
        x, v = F.col(c), F.lit(last[c]).cast(df.schema[c].dataType)
        # descending order puts missing values last
        beyond = beyond | (same & F.coalesce(x < v, v.isNotNull() & x.isNull()))
        same = same & x.eqNullSafe(v)
    return df.where(beyond).orderBy(*newest_first(df)).limit(limit)


def page_counts(df: DataFrame, limit: int) -> DataFrame:
    """Rows and both page counts: plain (0 when empty) and at least 1."""
    total = F.count(F.lit(1))
    pages = F.ceil(total / limit).cast("bigint")
    return df.agg(total.alias("total"), pages.alias("pages"), F.greatest(F.lit(1), pages).alias("pages_min_one"))


def filter_products(
    products: DataFrame, prices: DataFrame, category: str | None = None, platform: str | None = None,
    min_price: float | None = None, max_price: float | None = None,
) -> DataFrame:
    """Products by category and platform; each price bound must hold for some history row of its own."""
    out = products
    if category is not None:
        out = out.where(F.col("category") == category)
    if platform is not None:
        out = out.where(F.col("platform") == platform)
    for bound in (
        None if min_price is None else F.col("price") >= min_price,
        None if max_price is None else F.col("price") <= max_price,
    ):
        if bound is not None:
            # distinct keys combine on the map side, so a hot product costs one row per task
            out = out.join(prices.where(bound).select("product_id").distinct(), "product_id", "left_semi")
    return out


def recent_searches(df: DataFrame, user_id: int, now: Column, days: int = 7, limit: int = 15) -> DataFrame:
    since = now - F.make_dt_interval(F.lit(days))
    mine = df.where((F.col("user_id") == user_id) & (F.col("created_at") >= since))
    return mine.orderBy(F.desc("created_at"), F.desc("search_id")).limit(limit)


def latest_per_user(df: DataFrame, limit: int = 50) -> DataFrame:
    """Newest searches of every user; the rank filter also trims before the shuffle."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("search_id"))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def active_alerts(df: DataFrame, user_id: int) -> DataFrame:
    return df.where((F.col("user_id") == user_id) & F.col("is_active"))


def rules_by_consequent(rules: DataFrame, pattern: str, limit: int = 10) -> DataFrame:
    """Rules whose consequent matches a pattern, best lift first."""
    return best_rules(rules.where(F.col("consequent").rlike("(?i)" + pattern)), limit)


def best_rules(rules: DataFrame, limit: int = 20, by: str = "lift") -> DataFrame:
    return rules.orderBy(F.desc(by), "antecedent", "consequent").limit(limit)


def find_rules(rules: DataFrame, text: str = "", by: str = "lift", limit: int = 40, cleaned: bool = True) -> DataFrame:
    """Rules with the text on either side, sorted by a measure; labels cleaned before the search or not."""
    sides = [rule_label(F.col(c)) if cleaned else F.col(c) for c in ("antecedent", "consequent")]
    found = F.lower(sides[0]).contains(text.lower()) | F.lower(sides[1]).contains(text.lower())
    return best_rules(rules.where(found) if text else rules, limit, by)
