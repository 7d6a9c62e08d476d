"""Features read from an offer title. Built-in expressions only, so they stay in codegen.

Patterns carry ``(?U)`` because word borders and blanks are Unicode-aware.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from ..dims import (
    ACCESSORY_GAMING_WORDS, BRAND_PATTERNS, CPU_GENERATIONS, CPU_SCORES, GAMING_WORDS, GENERATION_RANGE,
    GPU_PATTERN, LAPTOP_WORDS, OTHER_BRAND, RAM_SIZES, REFURBISHED_PATTERN, STORAGE_KINDS, STORAGE_SIZES,
    TOUCH_PATTERN, UNKNOWN,
)
from .numeric import plain_blanks, strip

UNIT = r"(\d+)\s*(?:go|gb|g)\b"
# a storage word that ends within n characters after the unit, or begins within n before it
STORAGE_WITHIN_10 = r"(?s:.{0,7}(?:ssd|hdd)|.{0,6}(?:nvme|emmc|stor)|.{0,4}disque)"
STORAGE_WITHIN_15 = r"(?s:.{0,12}(?:ssd|hdd)|.{0,11}(?:nvme|emmc|stor)|.{0,9}disque)"
STORAGE_15_BEFORE = r"(?s:(?:ssd|hdd).{0,12}|(?:nvme|emmc|stor).{0,11}|disque.{0,9})"


def low(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit("")))


def alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    parts, depth = [""], 0
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return parts


def leading_literal(alternative: str) -> str:
    """Plain text every match of the alternative contains, '' when there is none at its start."""
    body = alternative.removeprefix(r"\b")
    text = re.match(r"[a-z0-9-]*", body).group()
    return text[:-1] if body[len(text):len(text) + 1] in ("?", "*") else text


def matches(text: Column, pattern: str) -> Column:
    """Regex search that first looks for the plain words of the pattern.

    Substring tests cost far less than a search with many alternatives, and
    most titles contain none of the words of a rule.
    """
    strong = {a: leading_literal(a) for a in alternatives(pattern) if len(leading_literal(a)) > 1}
    weak = [a for a in alternatives(pattern) if a not in strong]
    found = []
    if strong:
        found.append(contains_any(text, list(dict.fromkeys(strong.values()))) & text.rlike("(?U)" + "|".join(strong)))
    if weak:
        found.append(text.rlike("(?U)" + "|".join(weak)))
    return reduce(lambda a, b: a | b, found)


def first_rule(text: Column, rules: list, default: Column) -> Column:
    """Value of the first (value, pattern) rule that matches."""
    chain = F
    for value, pattern in rules:
        chain = chain.when(matches(text, pattern), F.lit(value))
    return chain.otherwise(default)


def first_int(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, "(?U)" + pattern, 1).try_cast("bigint")


def all_ints(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("bigint"))


def if_in(number: Column, allowed: list[int]) -> Column:
    """The number if it is allowed, else null; a map lookup evaluates it once."""
    pairs = [F.lit(x).cast("bigint") for size in allowed for x in (size, size)]
    return F.try_element_at(F.create_map(*pairs), number)


def collapse_blanks(title: Column) -> Column:
    """Trim and squeeze white space."""
    squeezed = F.regexp_replace(F.regexp_replace(title, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.when(plain_blanks(title), title).otherwise(squeezed)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def detect_brand(title: Column, brand: Column | None = None) -> Column:
    """Known brand by title, else the tidied brand column, else 'Autre'."""
    if brand is None:
        fallback = F.lit(OTHER_BRAND)
    else:
        own = strip(brand)
        fallback = (
            F.when(F.lower(own).isin("hp", "h.p"), F.lit("HP"))
            .when(F.length(own) > 1, title_case(own))
            .otherwise(F.lit(OTHER_BRAND))
        )
    return first_rule(low(title), BRAND_PATTERNS, fallback)


def near_words(text: Column, words: list[str], value: Column) -> Column:
    """The value, looked for only when one of the words is in the text at all."""
    return F.when(contains_any(text, words), value)


def extract_ram(title: Column) -> Column:
    """Memory in Go: megabytes, then a stated RAM size, then the last plain size, then the first."""
    text = low(title)
    stated = r"(\d+)\s*(?:go|gb)\s*(?:ram|ddr\d*|lpddr\d*|sdram)"
    stated_after = r"(?:ram|memoire|memory|mem)\s*:?\s*(\d+)\s*(?:go|gb|g\b)"
    sizes = F.filter(all_ints(text, UNIT), lambda x: x.isin(RAM_SIZES))
    free = F.filter(all_ints(text, UNIT + f"(?!{STORAGE_WITHIN_10})"), lambda x: x.isin(RAM_SIZES))
    return F.coalesce(
        near_words(text, ["mo"], if_in(F.floor(first_int(text, r"(\d+)\s*mo\b") / 1024), RAM_SIZES)),
        near_words(text, ["ram", "ddr"], if_in(first_int(text, stated), RAM_SIZES)),
        near_words(text, ["ram", "mem"], if_in(first_int(text, stated_after), RAM_SIZES)),
        F.try_element_at(free, F.lit(-1)),
        F.try_element_at(sizes, F.lit(1)),
    ).cast("int")


def extract_storage(title: Column) -> Column:
    """Storage in Go: terabytes, then sizes beside a storage word, then sizes that cannot be RAM."""
    text = low(title)
    kinds = ["ssd", "hdd", "nvme", "emmc"]
    tera = F.regexp_extract(text, r"(?U)(\d+(?:\.\d+)?)\s*(?:to|tb)\b", 1).try_cast("double")
    sized = r"(\d+)\s*(?:go|gb|g)\s*(?:ssd|hdd|nvme|emmc|disque|flash)"
    sized_after = r"(?:ssd|hdd|nvme|emmc)\s*[\s:]*(\d+)\s*(?:go|gb|g)\b"
    not_ram = [x for x in STORAGE_SIZES if x not in RAM_SIZES]
    sizes = F.filter(all_ints(text, UNIT), lambda x: x.isin(not_ram))
    near = rf"(?:(?<={STORAGE_15_BEFORE})|(?=\d+\s*(?:go|gb|g)\b{STORAGE_WITHIN_15})){UNIT}"
    beside = F.filter(all_ints(text, near), lambda x: x.isin(STORAGE_SIZES))
    return F.coalesce(
        near_words(text, ["to", "tb"], F.floor(tera * 1000).try_cast("int")),
        near_words(text, [*kinds, "disque", "flash"], if_in(first_int(text, sized), STORAGE_SIZES)),
        near_words(text, kinds, if_in(first_int(text, sized_after), STORAGE_SIZES)),
        near_words(text, kinds, if_in(first_int(text, r"(\d+)\s+(?:ssd|hdd|nvme)"), STORAGE_SIZES)),
        F.try_element_at(sizes, F.lit(1)),
        near_words(text, [*kinds, "disque", "stor"], F.try_element_at(beside, F.lit(1))),
    ).cast("int")


def storage_type(title: Column) -> Column:
    return first_rule(low(title), STORAGE_KINDS, F.lit(UNKNOWN))


def cpu_score(title: Column) -> Column:
    """0 (unknown) to 10."""
    return first_rule(low(title), CPU_SCORES, F.lit(0))


def cpu_generation(title: Column) -> Column:
    text = low(title)
    first, last = GENERATION_RANGE
    valid = list(range(first, last + 1))
    found = [near_words(text, words, if_in(first_int(text, p), valid)) for p, words in CPU_GENERATIONS]
    return F.coalesce(*found).cast("int")


def has_gpu(title: Column) -> Column:
    return matches(low(title), GPU_PATTERN)


def is_tactile(title: Column) -> Column:
    return matches(low(title), TOUCH_PATTERN)


def is_refurbished(title: Column) -> Column:
    return matches(low(title), REFURBISHED_PATTERN)


def contains_any(text: Column, words: list[str]) -> Column:
    """Substring test on one of the words (word borders do not count)."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def is_gaming_title(title: Column) -> Column:
    return contains_any(low(title), GAMING_WORDS)


def accessory_is_gaming(title: Column) -> Column:
    return contains_any(low(title), ACCESSORY_GAMING_WORDS)


def crawl_is_gaming(title: Column, words: tuple[str, ...] = ("gaming",)) -> Column:
    """Crawlers look for 'gaming', accessory ones also for 'gamer' or more."""
    return contains_any(low(title), list(words))


def is_laptop_title(title: Column) -> Column:
    """False for a missing title."""
    return contains_any(low(title), LAPTOP_WORDS)


def first_word(title: Column) -> Column:
    """First token of a title, 'Inconnu' when it is blank."""
    return F.coalesce(F.nullif(F.regexp_extract(title, r"(?U)\S+", 0), F.lit("")), F.lit(UNKNOWN))


def normalized_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")
