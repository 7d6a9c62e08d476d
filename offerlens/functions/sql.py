"""Title and price rules as SQL functions.

Each function is a Column rule of this package over its parameters, declared once in ``FUNCTIONS``. ``register_functions``
turns the rule into SQL text and creates a temporary SQL function from it, so the body is inlined into every plan that
calls it: there is no Python in such a plan, and the optimizer sees the expressions themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from . import features, prices, titles

#: name: (parameters, type of the result, rule). Parameters are not named like columns of offers: a body is inlined as a projection that
#: renames the argument, and over a union Spark 4.1 fails to plan two projections that rename a column to itself.
FUNCTIONS: dict[str, tuple[list[tuple[str, str]], str, Callable[..., Column]]] = {
    # titles
    "title_brand": ([("title_text", "STRING"), ("brand_text", "STRING")], "STRING", titles.detect_brand),
    "title_ram": ([("title_text", "STRING")], "INT", titles.extract_ram),
    "title_storage": ([("title_text", "STRING")], "INT", titles.extract_storage),
    "title_storage_type": ([("title_text", "STRING")], "STRING", titles.storage_type),
    "title_cpu_score": ([("title_text", "STRING")], "INT", titles.cpu_score),
    "title_cpu_generation": ([("title_text", "STRING")], "INT", titles.cpu_generation),
    "title_has_gpu": ([("title_text", "STRING")], "BOOLEAN", titles.has_gpu),
    "title_is_tactile": ([("title_text", "STRING")], "BOOLEAN", titles.is_tactile),
    "title_is_refurbished": ([("title_text", "STRING")], "BOOLEAN", titles.is_refurbished),
    "title_is_gaming": ([("title_text", "STRING")], "BOOLEAN", titles.is_gaming_title),
    "title_is_laptop": ([("title_text", "STRING")], "BOOLEAN", titles.is_laptop_title),
    "title_is_gaming_accessory": ([("title_text", "STRING")], "BOOLEAN", titles.accessory_is_gaming),
    "title_first_word": ([("title_text", "STRING")], "STRING", titles.first_word),
    "title_normalized": ([("title_text", "STRING")], "STRING", titles.normalized_title),
    "title_tidy": ([("title_text", "STRING")], "STRING", titles.collapse_blanks),
    # prices
    "price_free": ([("price_text", "STRING")], "DOUBLE", prices.parse_price),
    "price_mad": ([("price_text", "STRING"), ("currency_code", "STRING")], "DOUBLE", prices.price_in_mad),
    "price_offer_insert": ([("price_text", "STRING")], "DOUBLE", prices.offer_insert_price),
    "price_accessory_insert": ([("price_text", "STRING")], "DOUBLE", prices.accessory_insert_price),
    "price_refresh": ([("price_text", "STRING")], "DOUBLE", prices.refresh_price),
    "price_digits": ([("price_text", "STRING")], "BIGINT", prices.digits_price),
    "price_marketplace": ([("price_text", "STRING")], "DOUBLE", prices.marketplace_price),
    "price_card_accessory": ([("price_text", "STRING")], "DOUBLE", prices.card_accessory_price),
    "price_card_text": ([("price_text", "STRING")], "STRING", prices.card_price_text),
    "price_currency": ([("price_text", "STRING")], "STRING", prices.detect_currency),
    "price_card_currency": ([("price_text", "STRING")], "STRING", prices.card_currency),
    "currency_rate": ([("currency_code", "STRING")], "DOUBLE", prices.currency_rate),
    "accessory_currency_rate": ([("currency_code", "STRING")], "DOUBLE", prices.accessory_rate),
    # levels
    "price_level": ([("price_value", "DOUBLE")], "STRING", features.price_category),
    "basket_price_level": ([("price_value", "DOUBLE")], "STRING", features.basket_price_category),
    "ram_level": ([("ram_size", "INT")], "STRING", features.ram_category),
    "price_log": ([("price_value", "DOUBLE")], "DOUBLE", features.log_price),
    "price_per_gb": ([("price_value", "DOUBLE"), ("ram_size", "INT")], "DOUBLE", features.price_per_gb),
    "accessory_price_range": ([("category_name", "STRING"), ("price_value", "DOUBLE")], "STRING", features.price_range),
}

# a string literal; a call of an operator by its sign or word; a number with a fraction
_PART = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w.`])([-+*/%<>=!&|^~]+|and|or|not|in)(?=\()|(?<![\w.`])(\d+\.\d+(?:[eE][-+]?\d+)?)(?![\w.])", re.DOTALL)


def sql_text(rule: Column) -> str:
    """A Column as SQL text that Spark parses to the same expression.

    A Column prints operators as calls, which need back quotes to be parsed as such, and doubles as plain numbers, which would be
    parsed as decimals; string literals are left as they are.
    """
    text = str(rule).removeprefix("Column<'").removesuffix("'>")

    def mend(m: re.Match) -> str:
        if m[1]:
            return m[1]
        return f"`{m[2]}`" if m[2] else f"{m[3]}D"

    return _PART.sub(mend, text)


def function_sql(name: str) -> str:
    """The statement that creates a function of ``FUNCTIONS``."""
    parameters, result, rule = FUNCTIONS[name]
    listed = ", ".join(f"{p} {kind}" for p, kind in parameters)
    body = sql_text(rule(*(F.col(p) for p, _ in parameters)))
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({listed}) RETURNS {result} RETURN {body}"


def register_functions(spark: SparkSession) -> list[str]:
    """Create all functions in the session, and return their names."""
    for name in FUNCTIONS:
        spark.sql(function_sql(name))
    return list(FUNCTIONS)
