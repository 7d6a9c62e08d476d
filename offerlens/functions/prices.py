"""Price and currency parsing, one Column function per raw format."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..dims import ACCESSORY_RATES, LAPTOP_RATES
from .numeric import half_even, lookup, strip, to_number


def last_position(text: Column, char: str) -> Column:
    """1-based position of the last ``char``, 0 when absent."""
    return F.when(F.instr(text, char) == 0, F.lit(0)).otherwise(
        F.length(text) - F.instr(F.reverse(text), char) + 1
    )


def _decimal_text(text: Column, comma: Column, dot: Column) -> Column:
    """Bring a digits/comma/dot text to dot-decimal form given separator positions."""
    return (
        F.when((comma > 0) & (dot > 0) & (comma > dot), F.translate(F.translate(text, ".", ""), ",", "."))
        .when((comma > 0) & (dot > 0), F.translate(text, ",", ""))
        .otherwise(F.translate(text, ",", "."))
    )


def currency_rate(currency: Column) -> Column:
    """Rate to MAD for laptop offers: exact match, else upper-cased, else 1."""
    key = strip(currency)
    return F.coalesce(lookup(LAPTOP_RATES, key), lookup(LAPTOP_RATES, F.upper(key)), F.lit(1.0))


def accessory_rate(currency: Column, rates: dict[str, float] = ACCESSORY_RATES, trimmed: bool = False) -> Column:
    """Rate to MAD for accessories: upper-cased match, else 1.

    The batch form does not trim; the request form does and has no DH.
    """
    key = F.upper(strip(currency) if trimmed else currency)
    return F.coalesce(lookup(rates, key), F.lit(1.0))


def parse_price(raw: Column) -> Column:
    """Free price text to a positive number, else null.

    Everything but digits, comma and dot is dropped, so a minus sign vanishes.
    The decimal sign is the comma when it is the only kind of separator or
    when the first dot comes before it, else the dot; its last occurrence
    counts and all other separators are dropped. Each step uses the text once,
    which keeps the expression small when filters copy it.
    """
    text = F.regexp_replace(raw, r"[^\d,.]", "")
    text = F.regexp_replace(text, r"^(?=\d*\.[^,]*,|[\d,]+$)(.*),([^,]*)$", "$1;$2")
    text = F.regexp_replace(text, r"^([^;]*)\.([^;.]*)$", "$1;$2")
    parsed = F.translate(text, ";.,", ".").try_cast("double")
    # most prices are plain: digits and one dot need no pattern at all
    plain = F.when(F.translate(raw, "0123456789.", "") == "", raw.try_cast("double"))
    return F.nullif(F.coalesce(plain, parsed), F.lit(0.0))


def parse_numeric_price(raw: Column) -> Column:
    """Same rule for a price that is already a number."""
    number = F.abs(raw.cast("double"))
    return F.when(~F.isnan(number) & (number > 0), number)


def price_in_mad(raw: Column, currency: Column | None = None, numeric: bool = False) -> Column:
    """Raw price and currency to MAD, two digits."""
    number = parse_numeric_price(raw) if numeric else parse_price(raw)
    rate = currency_rate(currency) if currency is not None else F.lit(1.0)
    return half_even(number * rate, 2)


def offer_insert_price(raw: Column) -> Column:
    """Price as stored by the laptop insert: blanks out, comma to dot, bad or missing is 0."""
    text = F.translate(F.translate(raw, "   ", ""), ",", ".")
    return F.coalesce(F.when(~raw.isin("N/A", "None", ""), to_number(text)), F.lit(0.0))


def accessory_insert_price(raw: Column) -> Column:
    """Price as stored by the accessory insert; null marks a row to skip."""
    empty = raw.isNull() | raw.isin("N/A", "")
    return F.when(empty, F.lit(0.0)).otherwise(to_number(F.translate(raw, ",", ".")))


def refresh_price(raw: Column) -> Column:
    """Price of the table refresh: comma to dot, other signs out, bad is 0."""
    text = F.regexp_replace(F.translate(raw, ",", "."), r"[^\d.]", "")
    return F.coalesce(to_number(text), F.lit(0.0))


def digits_price(raw: Column) -> Column:
    """All digits of the text as one whole number, 0 when there are none.

    "12 500,00 MAD" gives 1250000: decimals are not split off.
    """
    return F.coalesce(F.regexp_replace(raw, r"[^\d]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def marketplace_price(raw: Column) -> Column:
    """Card price where the last separator is the decimal one; bad is 0."""
    text = F.regexp_replace(raw, r"[^\d.,]", "")
    text = _decimal_text(text, last_position(text, ","), last_position(text, "."))
    return F.coalesce(to_number(text), F.lit(0.0))


def card_accessory_price(raw: Column) -> Column:
    """Card price with comma to dot, two digits; bad is 0."""
    text = F.translate(F.regexp_replace(raw, r"[^\d,.]", ""), ",", ".")
    return F.coalesce(half_even(to_number(text), 2), F.lit(0.0))


def card_price_text(raw: Column) -> Column:
    """Digits, comma and dot of a card price, 'N/A' when there is no digit."""
    return F.when(raw.rlike(r"\d"), F.regexp_replace(raw, r"[^\d,.]", "")).otherwise(F.lit("N/A"))


def card_currency(raw: Column) -> Column:
    """First run of currency signs in a card price, else 'N/A'."""
    sign = F.nullif(F.regexp_extract(raw, r"(?U)[^\d,.\s]+", 0), F.lit(""))
    return F.coalesce(F.when(raw.rlike(r"\d"), sign), F.lit("N/A"))


def detect_currency(raw: Column) -> Column:
    """MAD, then EUR, then USD, then the first letters or sign, else 'inconnu'."""
    first = F.nullif(F.regexp_extract(raw, r"([A-Za-z]+|€|\$|£)", 1), F.lit(""))
    return F.coalesce(
        F.when(raw.contains("MAD"), F.lit("MAD"))
        .when(raw.contains("€") | raw.contains("EUR"), F.lit("EUR"))
        .when(raw.contains("$") | raw.contains("USD"), F.lit("USD"))
        .otherwise(first),
        F.lit("inconnu"),
    )
