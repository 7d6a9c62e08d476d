"""Numeric helpers on Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def half_even(col: Column, digits: int) -> Column:
    """Round to ``digits`` with ties to even, the way array libraries round.

    Noise beyond six further digits is settled first, so that a mean which
    lies on a tie does not depend on the order of its summation.
    """
    scale = float(10**digits)
    settled = F.rint(col * F.lit(scale) * F.lit(1e6)) / F.lit(1e6)
    return F.rint(settled) / F.lit(scale)


def to_number(text: Column) -> Column:
    """Text to double, null when it is not a plain number (never throws)."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def finite(col: Column) -> Column:
    """NaN and infinities become null."""
    bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(~bad, col)


def plain_blanks(text: Column) -> Column:
    """Whether a text is ASCII and has no white space but single blanks inside; a few substring tests, for what needs no pattern."""
    bad = text.contains("  ") | text.startswith(" ") | text.endswith(" ")
    for sign in "\t\n\x0b\f\r":
        bad = bad | text.contains(sign)
    return (F.octet_length(text) == F.length(text)) & ~bad


def strip(text: Column) -> Column:
    """Trim all white space, also no-break spaces."""
    return F.when(plain_blanks(text), text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def lookup(values: dict[str, float], key: Column) -> Column:
    """Value of a short fixed table, null when the key is not in it."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)
