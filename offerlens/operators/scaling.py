"""Median imputation and scaling with exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import half_even
from ..session import stored
from .distribution import attach, quantiles


MARKS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, x, c): distinct values of several columns with counts, missing values included; written once."""
    entries = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return stored(long.groupBy("name", "x").agg(F.count(F.lit(1)).alias("c")), "value-counts")


def _as_map(rows: DataFrame, fields: list[str]) -> Column:
    """Map name -> struct of a table with one row per column, as one scalar subquery."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct(*fields))))).scalar()


def medians_of(df: DataFrame, columns: list[str]) -> Column:
    """Map column name -> struct(median)."""
    return _as_map(quantiles(column_counts(df, columns), ["name"], "x", {"median": 0.5}, weight="c"), ["median"])


def imputed_marks(df: DataFrame, columns: list[str]) -> Column:
    """Map column name -> struct(fill, q1, median, q3); the marks are those of the imputed column."""
    counts = column_counts(df, columns)
    fill = quantiles(counts, ["name"], "x", {"fill": 0.5}, weight="c")
    filled = counts.join(fill, "name", "left").select(
        "name", F.coalesce("x", "fill", F.lit(0.0)).alias("x"), "c", F.coalesce("fill", F.lit(0.0)).alias("fill")
    )
    marks = quantiles(filled, ["name"], "x", MARKS, weight="c")
    return _as_map(marks.join(fill, "name", "left"), ["fill", *MARKS])


def _filled(marks: Column, column: str, field: str) -> Column:
    known = F.try_element_at(marks, F.lit(column)).getField(field)
    return F.coalesce(F.col(column).cast("double"), known, F.lit(0.0))


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of the columns become the column median (0 when all are missing)."""
    marked = df.withColumn("_marks", medians_of(df, columns))
    return marked.withColumns({c: _filled(F.col("_marks"), c, "median") for c in columns}).drop("_marks")


def scaled(df: DataFrame, columns: list[str], method: str = "robust", digits: int | None = 6) -> DataFrame:
    """Add ``<column>_scaled``: minmax, standard (population deviation) or robust (median and IQR).

    Missing values are imputed by the median first; the original columns stay.
    A constant column has scale 1. Any other method name means robust.
    """
    parts: dict[str, tuple[Column, Column, Column]] = {}
    if method in ("minmax", "standard"):
        first, spread = {"minmax": (F.min, lambda x: F.max(x) - F.min(x)), "standard": (F.avg, F.stddev_pop)}[method]
        ready = imputed(df.select(*columns), columns)
        whole = ready.agg(*[first(c).alias(f"o_{c}") for c in columns], *[spread(c).alias(f"s_{c}") for c in columns])
        marked = attach(df.withColumn("_marks", medians_of(df, columns)), whole, "_whole")
        for c in columns:
            parts[c] = (_filled(F.col("_marks"), c, "median"), F.col(f"_whole.o_{c}"), F.col(f"_whole.s_{c}"))
    else:
        marked = df.withColumn("_marks", imputed_marks(df, columns))
        for c in columns:
            m = F.try_element_at("_marks", F.lit(c))
            parts[c] = (_filled(F.col("_marks"), c, "fill"), m.getField("median"), m.getField("q3") - m.getField("q1"))
    out = {}
    for c, (filled_c, origin, width) in parts.items():
        value = (filled_c - origin) / F.when(width == 0, F.lit(1.0)).otherwise(width)
        out[f"{c}_scaled"] = value if digits is None else half_even(value, digits)
    return marked.withColumns(out).drop("_marks", "_whole")


def fixed_scaled(df: DataFrame, columns: dict[str, Column], names: list[str]) -> DataFrame:
    """Add imputed robust-scaled columns whose marks are known numbers.

    Two jobs over the stored value counts read the marks, one row per column; after them the new columns are
    plain projections, so that passes of an iterative model do not compute the marks again.
    """
    ready = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    counts = column_counts(ready, list(columns))
    fills = {r["name"]: r["fill"] for r in quantiles(counts, ["name"], "x", {"fill": 0.5}, weight="c").collect()}
    chain = F
    for n in columns:
        chain = chain.when(F.col("name") == n, F.lit(fills.get(n) or 0.0))
    filled = counts.select("name", F.coalesce("x", chain.otherwise(F.lit(0.0))).alias("x"), "c")
    marks = {r["name"]: r for r in quantiles(filled, ["name"], "x", MARKS, weight="c").collect()}
    out = {}
    for name, (n, c) in zip(names, columns.items()):
        m = marks.get(n)
        center, width = (m["median"], (m["q3"] - m["q1"]) or 1.0) if m else (0.0, 1.0)
        # adding zero folds -0.0 into 0.0, so equal values have equal keys
        out[name] = (F.coalesce(c.cast("double"), F.lit(fills.get(n) or 0.0)) - F.lit(center)) / F.lit(width) + 0.0
    return df.withColumns(out)


def normalized_prices(df: DataFrame) -> DataFrame:
    """Add ``price_normalized``: min-max, 0 for a constant column, missing stays missing."""
    low, high = F.col("_q.a"), F.col("_q.z")
    value = F.when(low == high, F.lit(0.0)).otherwise(
        F.when(F.col("price").isNotNull(), half_even((F.col("price") - low) / (high - low), 6))
    )
    ends = df.agg(F.min("price").alias("a"), F.max("price").alias("z"))
    return attach(df, ends).withColumn("price_normalized", value).drop("_q")


def usable_features(df: DataFrame, columns: list[str], share: float = 0.2, always: str = "log_price") -> list[str]:
    """Columns that exist and are known in enough rows (one aggregate, one row to the driver)."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return []
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in present]).first()
    kept = [c for c in present if (row[c] or 0.0) >= share]
    if always in df.columns and always not in kept:
        kept.insert(0, always)
    return kept
