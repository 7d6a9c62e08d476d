"""Association rules between offer attributes.

Baskets are first collapsed to distinct baskets with counts, so itemsets are
enumerated once per distinct basket and not once per offer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from ..functions.features import basket_price_category, item, price_range, yes_no
from ..functions.numeric import half_even
from ..session import materialize, stored
from .sampling import paired

LAPTOP_ITEMS = ["brand_detected", "price_category", "is_gaming", "has_gpu", "cluster"]
ACCESSORY_ITEMS = ["accessory_category", "source", "price_range"]


def baskets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(items, c): distinct sorted item arrays with counts; booleans read Oui or Non.

    The values pass through a generator of one row: labels and filters read a computed value several times.
    """
    values = [F.col(name).alias(f"v{n}") for n, name in enumerate(columns)]
    rows = df.select(F.explode(F.array(F.struct(*values))).alias("_r")).select("_r.*")
    items = []
    for n, name in enumerate(columns):
        value = F.col(f"v{n}")
        if isinstance(df.schema[name].dataType, BooleanType):
            value = yes_no(name, value)
        items.append(item(name, value))
    cells = rows.select(*[i.alias(f"i{n}") for n, i in enumerate(items)])
    counts = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("c"))
    return counts.select(F.array_sort(F.array_compact(F.array(*cells.columns))).alias("items"), "c")


def adapted_support(counted: DataFrame, base: float) -> Column:
    """Support threshold by table size: small tables take a third or half of it, within limits."""
    rows = F.sum("c")
    limit = (
        F.when(rows < 100, F.lit(max(0.03, base / 3))).when(rows < 500, F.lit(max(0.05, base / 2)))
        .otherwise(F.lit(base))
    )
    return counted.agg(limit).scalar()


def _combinations(items: Column, size: int) -> Column:
    """All sorted sub-arrays of a size of at least 1."""
    if size == 1:
        return F.transform(items, lambda x: F.array(x))
    count = F.size(items)
    rest = lambda i: F.slice(items, i + 2, F.greatest(count - i - 1, F.lit(0)))
    return F.flatten(F.transform(
        items, lambda x, i: F.transform(_combinations(rest(i), size - 1), lambda others: F.concat(F.array(x), others))
    ))


def _pairs(items: Column) -> Column:
    """All sorted pairs of a sorted array."""
    rest = lambda i: F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0)))
    return F.flatten(F.transform(items, lambda x, i: F.transform(rest(i), lambda y: F.array(x, y))))


def _candidates(frequent: DataFrame, size: int) -> DataFrame:
    """Itemsets of ``size`` all of whose subsets of one item less are frequent.

    Two sets that differ in their last item only are joined; the subsets are then looked up.
    """
    prefix, last = F.slice("items", 1, size - 2), F.element_at("items", -1)
    ends = frequent.groupBy(prefix.alias("p")).agg(F.array_sort(F.collect_list(last)).alias("ends"))
    joined = ends.select(F.explode(F.transform(_pairs(F.col("ends")), lambda x: F.concat("p", x))).alias("items"))
    if size == 2:
        return joined
    subsets = F.transform("items", lambda x: F.array_except("items", F.array(x)))
    parts = joined.select(F.col("items").alias("whole"), F.explode(subsets).alias("items"))
    held = parts.join(frequent, "items", "left_semi").groupBy("whole").agg(F.count(F.lit(1)).alias("n"))
    return held.where(F.col("n") == size).select(F.col("whole").alias("items"))


def frequent_itemsets(counted: DataFrame, support: Column | float, max_len: int = 3) -> DataFrame:
    """(items, support) of all itemsets up to ``max_len`` items with enough support, level by level.

    A basket keeps the frequent sets it holds, one row each. Sets of the next size come from two of them that differ in the last
    item, and only those count whose subsets are all frequent, so a wide basket is never taken apart into all its subsets.
    Levels end when nothing is frequent any more.
    """
    if max_len < 1:
        raise ValueError("max_len is at least 1")
    full = counted.where(F.size("items") > 0)
    limit = support if isinstance(support, Column) else F.lit(float(support))

    def enough(held: DataFrame) -> DataFrame:
        found = held.groupBy("items").agg(F.sum("c").alias("c"))
        return found.select("items", (F.col("c") / rows).alias("support")).where(F.col("support") >= limit)

    baskets_ = stored(full.select(F.monotonically_increasing_id().alias("b"), F.array_distinct("items").alias("all"), "c"), "baskets")
    rows = baskets_.agg(F.sum("c")).scalar()  # of the written baskets: every level reads it
    held = baskets_.select("b", "c", F.explode(F.transform("all", lambda x: F.array(x))).alias("items"))
    frequent = stored(enough(held), "itemsets")
    levels = frequent
    for size in range(2, max_len + 1):
        known = held.join(frequent, "items", "left_semi")
        prefix, last = F.slice("items", 1, size - 2), F.element_at("items", -1)
        # at most as many ends as the basket has items
        ends = known.groupBy("b", "c", prefix.alias("p")).agg(F.array_sort(F.collect_list(last)).alias("ends"))
        larger = ends.select("b", "c", F.explode(F.transform(_pairs(F.col("ends")), lambda x: F.concat("p", x))).alias("items"))
        held = larger.join(_candidates(frequent, size), "items", "left_semi") if size > 2 else larger
        if 2 < size < max_len:  # the next level would form them again
            held = stored(held, "held-sets")
        frequent = stored(enough(held), "itemsets")
        if frequent.isEmpty():
            break
        levels = levels.unionByName(frequent)
    return levels


def association_rules(itemsets: DataFrame, confidence: float = 0.6, lift: float = 1.0, max_len: int = 3) -> DataFrame:
    """Rules from every split of every itemset, of ``max_len`` items at most, into antecedent and consequent."""
    whole = itemsets.where((F.size("items") > 1) & (F.size("items") <= max_len))
    none = F.array().cast("array<array<string>>")
    sides = F.concat(none, *[
        F.when(F.size("items") > n, _combinations(F.col("items"), n)).otherwise(none) for n in range(1, max_len)
    ])
    split = whole.select("items", "support", F.explode(sides).alias("a")).withColumn(
        "b", F.array_except("items", "a")
    )
    left = itemsets.select(F.col("items").alias("a"), F.col("support").alias("sa"))
    right = itemsets.select(F.col("items").alias("b"), F.col("support").alias("sb"))
    measured = (
        split.join(left, "a").join(right, "b", "left")
        .withColumn("confidence", F.col("support") / F.col("sa"))
        .withColumn("lift", F.coalesce(F.col("confidence") / F.col("sb"), F.lit(0.0)))
        .where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))
    )
    return measured.select(
        F.array_join("a", ", ").alias("antecedent"), F.array_join("b", ", ").alias("consequent"),
        half_even(F.col("support"), 4).alias("support"), half_even(F.col("confidence"), 4).alias("confidence"),
        half_even(F.col("lift"), 4).alias("lift"),
    ).distinct()


def _rules(df: DataFrame, columns: list[str], support: float, confidence: float, lift: float, max_len: int = 3):
    # distinct baskets and frequent itemsets are small and read several times: write each once
    counted = materialize(baskets(df, columns))
    itemsets = materialize(frequent_itemsets(counted, adapted_support(counted, support), max_len))
    return association_rules(itemsets, confidence, lift)


def _available(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    present = [c for c in wanted if c in df.columns]
    if present:
        return df, present
    if "price" in df.columns and "price_category" not in df.columns:
        return df.withColumn("price_category", basket_price_category(F.col("price"))), ["price_category"]
    raise ValueError(f"none of the columns {wanted} is there")


def laptop_rules(
    df: DataFrame, columns: list[str] | None = None, support: float = 0.08, confidence: float = 0.6,
    lift: float = 1.2, max_len: int = 3,
) -> DataFrame:
    """Rules between brand, price level, gaming, graphics card and segment."""
    if columns is None:
        df, columns = _available(df, LAPTOP_ITEMS)
    return _rules(df, columns, support, confidence, lift, max_len)


def accessory_rules(
    df: DataFrame, support: float = 0.05, confidence: float = 0.5, lift: float = 1.0
) -> DataFrame:
    """Rules between accessory category, shop, price range and gaming."""
    if "price_range" not in df.columns:
        df = df.withColumn("price_range", price_range(F.col("accessory_category"), F.col("price")))
    df, columns = _available(df, ACCESSORY_ITEMS)
    if "is_gaming" in df.columns:
        flag = F.coalesce(F.col("is_gaming").cast("boolean"), F.lit(False))
        df = df.withColumn("is_gaming_str", yes_no("gaming", flag))
        columns = [*columns, "is_gaming_str"]
    return _rules(df, columns, support, confidence, lift)


def cross_rules(
    laptops: DataFrame, accessories: DataFrame, size: int | None = None, support: float = 0.05, confidence: float = 0.4,
    lift: float = 1.0, seed: int = 42,
) -> DataFrame:
    """Rules over laptop and accessory rows paired by place in two independent orders, or in samples of ``size`` rows.

    The pairing carries no information: rules show coincidence of frequent values.
    """
    lap = [c for c in ["price_category", "brand_detected", "is_gaming"] if c in laptops.columns]
    acc = [c for c in ["accessory_category", "price_range"] if c in accessories.columns]
    ids = ["link", "title", "price", "source"]
    flag = F.initcap(F.col("is_gaming").cast("string"))
    left = laptops.select(*ids, *[
        (flag if c == "is_gaming" else F.col(c).cast("string")).alias(f"laptop_{c}") for c in lap
    ])
    right = accessories.select(*ids, *[F.col(c).cast("string").alias(f"acc_{c}") for c in acc])
    both = paired(left, right, size, ids, seed)
    return _rules(both, both.columns, support, confidence, lift)
