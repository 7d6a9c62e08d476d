"""Features of price, size and status columns, URLs and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..dims import (
    ACCESSORY_RANGE_CUTS, BASKET_PRICE_LEVELS, BASKET_TOP_PRICE_LEVEL, OTHER_ACCESSORY_RANGE_CUTS, PRICE_LEVELS,
    RAM_LEVELS, TOP_PRICE_LEVEL, TOP_RAM_LEVEL, UNKNOWN,
)
from .numeric import half_even, strip


def price_category(price: Column) -> Column:
    chain = F
    for below, name in PRICE_LEVELS:
        chain = chain.when(price < below, F.lit(name))
    return chain.when(price.isNotNull(), F.lit(TOP_PRICE_LEVEL))


def basket_price_category(price: Column) -> Column:
    """Fallback levels of the basket step: right-closed, null outside (0, inf)."""
    chain = F.when(price <= 0, F.lit(None).cast("string"))
    for up_to, name in BASKET_PRICE_LEVELS:
        chain = chain.when(price <= up_to, F.lit(name))
    return chain.when(price.isNotNull(), F.lit(BASKET_TOP_PRICE_LEVEL))


def ram_category(ram: Column, compat: bool = False) -> Column:
    """Memory level; a missing size is 'Inconnu', or the top level with ``compat``."""
    chain = F.when(ram.isNull(), F.lit(TOP_RAM_LEVEL if compat else UNKNOWN))
    for up_to, name in RAM_LEVELS:
        chain = chain.when(ram <= up_to, F.lit(name))
    return chain.otherwise(F.lit(TOP_RAM_LEVEL))


def log_price(price: Column) -> Column:
    return F.log10(F.greatest(price, F.lit(1.0)))


def price_per_gb(price: Column, ram: Column) -> Column:
    return half_even(F.when(ram > 0, price / ram), 2)


def price_range(category: Column, price: Column) -> Column:
    """Accessory price range: bas, moyen or haut, by category cut-offs."""
    low_cut, high_cut = (F.lit(x) for x in OTHER_ACCESSORY_RANGE_CUTS)
    for name, (a, b) in ACCESSORY_RANGE_CUTS.items():
        same = F.lower(category) == name
        low_cut = F.when(same, F.lit(a)).otherwise(low_cut)
        high_cut = F.when(same, F.lit(b)).otherwise(high_cut)
    return F.when(price < low_cut, F.lit("bas")).when(price < high_cut, F.lit("moyen")).otherwise(F.lit("haut"))


def truth_text(text: Column) -> Column:
    """Text flag: true, 1 or yes; missing is false."""
    return F.coalesce(F.lower(strip(text)).isin("true", "1", "yes"), F.lit(False))


def absolute_url(href: Column, host: str) -> Column:
    """http links stay, '//' gets a scheme, other links get the shop host."""
    return (
        F.when(href.startswith("http"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .otherwise(F.concat(F.lit(host), href))
    )


def link_id(link: Column) -> Column:
    return F.md5(link.cast("binary"))


def shorten(text: Column, length: int) -> Column:
    """First characters of a text for display."""
    return F.substring(text, 1, length)


def rule_label(text: Column) -> Column:
    """Readable label of a rule side."""
    for old, new in [
        ("is_gaming=is_gaming=", "gaming="), ("has_gpu=has_gpu=", "gpu="), ("brand_detected=", "marque="),
        ("price_category=", "gamme="), ("accessory_category=", "cat="), ("price_range=", "prix="),
        ("source=", "src="), ("_", " "),
    ]:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def item(name: str, value: Column) -> Column:
    """Basket item "name=value"; null for missing or blank values."""
    text = value.cast("string")
    return F.when(~strip(text).isin("", "nan", "None"), F.concat(F.lit(name + "="), text))


def yes_no(name: str, flag: Column) -> Column:
    """Boolean as the basket label "name=Oui" or "name=Non"."""
    return F.when(flag, F.lit(f"{name}=Oui")).when(~flag, F.lit(f"{name}=Non"))
