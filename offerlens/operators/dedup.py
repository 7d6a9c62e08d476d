"""Keep-first rules.

Survivors are picked with an aggregate over structs rather than a window: the
aggregate combines on the map side, so a key that holds a large share of the
rows (a missing link, say) is already reduced to one row per task before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DatetimeType, NumericType

from ..functions.features import shorten
from ..functions.numeric import strip
from ..functions.titles import normalized_title
from ..session import stored


def keep_first(df: DataFrame, keys: dict[str, Column], order: list[str], newest: bool = True) -> DataFrame:
    """One row per key: the first by ``order`` descending (or ascending).

    All other columns break ties in the same direction, so the survivor does
    not depend on how the data is split. Missing keys count as equal.
    """
    ranked = [*order, *[c for c in df.columns if c not in order]]
    best = (F.max if newest else F.min)(F.struct(*ranked)).alias("_row")
    named = [column.alias(f"_key_{name}") for name, column in keys.items()]
    picked = df.groupBy(*named).agg(best)
    return picked.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedup_links(df: DataFrame, order: str = "id") -> DataFrame:
    """One offer per link, newest first; without links by title, price and source."""
    names = ["link"] if "link" in df.columns else ["title", "price", "source"]
    keys = {name: F.col(name) for name in names}
    return keep_first(df, keys, [order] if order in df.columns else names)


def dedup_listing(df: DataFrame, order: list[str]) -> DataFrame:
    """One offer per (trimmed lower title, price rounded to whole, source)."""
    keys = {
        "title": strip(F.lower("title")), "price": F.rint("price"), "source": F.col("source"),
    }
    return keep_first(df, keys, order, newest=False)


def dedup_display(df: DataFrame, order: list[str]) -> DataFrame:
    """One offer per (first 60 title characters, price)."""
    return keep_first(df, {"title": shorten(F.col("title"), 60), "price": F.col("price")}, order, newest=False)


def crawl_dedup(df: DataFrame, order: list[str], run: tuple[str, ...] = ()) -> DataFrame:
    """Keep an offer unless a kept earlier one has its link or its normalised title.

    A dropped offer reserves neither its link nor its title, so the rule reads
    like a scan in order. It is computed in rounds: an open offer that comes
    first for both its link and its title is kept, open offers that share a
    link or title with a kept one are dropped, the rest stays open. Each round
    decides at least the earliest open offer; chains of conflicts set the
    number of rounds. ``order`` must be a total order of the offers. Offers of
    different crawl runs, named by the columns ``run``, do not conflict.
    Missing links count as equal.

    What the rule reads is written once, each column once. A round looks for the first offer of each title, then for
    the first one of these offers' links only; tables of firsts are written, so that Spark knows their sizes and sends
    small ones to the open offers instead of shuffling those.
    """
    title = normalized_title(F.coalesce("title", F.lit("")))
    # structs, since their missing fields compare as equal
    at = F.struct(*order).alias("_at")
    named = list(dict.fromkeys([*run, "link", *order]))
    rows = stored(df.select(*named, title.alias("_name")), "crawl-offers")
    open_offers = rows.select(
        F.struct(*run, "link").alias("_link"), F.struct(*run, F.col("_name").alias("name")).alias("_title"), at, F.col(order[0]).alias("_lead"))
    fixed = isinstance(rows.schema[order[0]].dataType, (NumericType, DatetimeType))
    kept_rounds: list[DataFrame] = []
    while True:
        first = stored(_first_of(open_offers, "_title", fixed).select("_title", "_first.*"), "crawl-first")
        rivals = open_offers.join(first.select("_link").distinct(), "_link", "left_semi")
        lowest = _first_of(rivals, "_link", fixed).select("_link", F.col("_first._at").alias("_lowest"))
        kept = stored(first.join(lowest, "_link").where(F.col("_at") == F.col("_lowest")).select("_link", "_title", "_at"), "crawl-kept")
        kept_rounds.append(kept)
        open_offers = stored(
            open_offers.join(kept.select("_link"), "_link", "left_anti").join(kept.select("_title"), "_title", "left_anti"), "crawl-open")
        if open_offers.isEmpty():
            break
    survivors = kept_rounds[0]
    for kept in kept_rounds[1:]:
        survivors = survivors.unionByName(kept)
    return df.withColumn("_at", at).join(survivors.select("_at"), "_at", "left_semi").select(*df.columns)


def _first_of(offers: DataFrame, key: str, fixed: bool) -> DataFrame:
    """(key, _first): the first offer of each key, as a struct of ``_at`` and ``_link``.

    With a ``_lead`` of fixed width, the lowest leads are counted first, in hash tables; only offers that have them are compared in full.
    """
    if fixed:
        missing, lead = F.max(F.col("_lead").isNull()), F.min("_lead")
        lowest = offers.groupBy(key).agg(F.when(~missing, lead).alias("_low"))
        lowest = stored(lowest, "crawl-lowest").withColumnRenamed(key, "_key")
        offers = offers.join(lowest, (F.col(key) == F.col("_key")) & F.col("_lead").eqNullSafe(F.col("_low")), "left_semi")
    return offers.groupBy(key).agg(F.min(F.struct("_at", "_link")).alias("_first"))


def crawl_dedup_check(df: DataFrame, order: list[str], run: tuple[str, ...] = ()) -> DataFrame:
    """One row that is zero but for ``offers`` exactly when ``crawl_dedup`` equals the scan in order.

    No two survivors share a link or a title, and each dropped offer comes
    after a survivor with its link or title; only one set of survivors
    fulfils both.
    """
    kept = stored(crawl_dedup(df, order, run).select(*dict.fromkeys([*run, "link", "title", *order])), "crawl-survivors")
    title = normalized_title(F.coalesce("title", F.lit(""))).alias("name")

    def earliest(*key: str | Column, name: str) -> DataFrame:
        return kept.groupBy(F.struct(*run, *key).alias(name)).agg(
            F.min(F.struct(*order)).alias(f"_first{name}"), F.count(F.lit(1)).alias("_n"))

    by_link, by_title = earliest("link", name="_link"), earliest(title, name="_title")
    offers = df.select(F.struct(*order).alias("_at"), F.struct(*run, "link").alias("_link"), F.struct(*run, title).alias("_title"))
    known = offers.join(by_link.drop("_n"), "_link", "left").join(by_title.drop("_n"), "_title", "left")
    at = F.col("_at")
    itself = (at == F.col("_first_link")) & (at == F.col("_first_title"))
    later = (F.col("_first_link") < at) | (F.col("_first_title") < at)
    unexplained = known.agg(
        F.count(F.lit(1)).alias("offers"), F.count_if(~F.coalesce(itself, F.lit(False)) & ~F.coalesce(later, F.lit(False))).alias("unexplained"))
    shared = {name: side.agg(F.count_if(F.col("_n") > 1)).scalar() for name, side in
              {"shared_links": by_link, "shared_titles": by_title}.items()}
    return unexplained.select("offers", *[n.alias(name) for name, n in shared.items()], "unexplained")


def product_key(df: DataFrame) -> DataFrame:
    """Distinct products (title, platform, category) with a surrogate key."""
    key = F.sha2(F.to_json(F.struct("title", "platform", "category")), 256)
    return df.select("title", "platform", "category").distinct().withColumn("product_key", key)
