"""Mixing sources to target weights by capped water-filling.

Targets: every source gets the water level times its weight, clamped at ``max_epochs`` times its size; the excess goes to
the others by weight. Clamped sources are those with the smallest ratio of cap to weight, so running sums over the table
of sources (one row per source) give the level without iteration.

Sample: a source's rate is target / size. Each document is taken floor(rate) times whole. For the fractional repetition
the documents of a source stand in the order of a seeded hash, and are taken until their words reach the fraction. Sums
per (source, hash bucket) find the bucket where that happens; only its rows are sorted, so a source that holds a third
of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

BUCKETS = 4096  # of a 32-bit hash


def source_targets(sizes: DataFrame, weights: list[int], share: float, max_epochs: int) -> DataFrame:
    """Per source: source_size and target. ``sizes`` has source and size; the result has a row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("*", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.select(
        "*",
        ((F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))).alias("level"),
    )
    # a source is clamped when the level without it would lift it above its cap
    clamped = F.col("weight") * F.col("level") > F.col("cap")
    final = F.min(F.when(~clamped, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)
    return per.select(
        "source", "source_size", "weight",
        F.when(clamped, F.col("cap").cast("double")).otherwise(F.col("weight") * final["level"]).alias("target"),
    )


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 7,
) -> DataFrame:
    """Per row: doc_id, size (words), source_size, target (of its source), copies (times taken), taken (words, repeats counted).

    Sources in code point order, null last, get ``weights`` in turn. A null or empty text has size 0 and is taken as often
    as the hash order says, with 0 words. A source without words has target 0. Rows with the same doc_id are rows of
    their own; which of two repeated rows is taken does not change the multiset. Other columns are ignored.
    """
    sizes = stored(_sized(docs, id_col, text_col, source_col, seed).drop("row"), "mix-sizes")
    return _taken(sizes, _plan(sizes, weights, share, max_epochs)).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 7,
) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as the mix takes it."""
    rows = _sized(docs, id_col, text_col, source_col, seed)
    plan = _plan(stored(rows.drop("row"), "mix-sizes"), weights, share, max_epochs)
    taken = _taken(rows, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select("row.*")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    u = F.conv(F.substring(F.md5(mark), 1, 8), 16, 10).cast("long")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("size"), u.alias("u"),
        F.shiftright(u, 32 - (BUCKETS.bit_length() - 1)).cast("int").alias("bucket"), F.struct(*docs.columns).alias("row"),
    )


def _plan(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """Per source: target, whole repetitions, words of the fractional one, and the hash bucket where it ends."""
    targets = source_targets(sizes, list(weights), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = stored(
        targets.select("*", whole.alias("whole")).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets"
    )
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    cut = (
        buckets.select("source", "bucket", "words", upto.alias("upto"))
        .alias("b").join(targets.select("source", "part").alias("t"), F.expr("b.source <=> t.source"))
        .where(F.col("upto") > F.col("part")).groupBy("b.source")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
        .select("source", "cut.bucket", "cut.before")
    )
    return stored(
        targets.alias("t").join(cut.alias("c"), F.expr("t.source <=> c.source"), "left").select(
            "t.source", "source_size", "target", "whole", "part", F.coalesce("c.bucket", F.lit(BUCKETS)).alias("cut_bucket"),
            F.coalesce("before", F.lit(0)).alias("before"),
        ), "mix-plan",
    )


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan and copies."""
    both = rows.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select("d.*", *[f"p.{c}" for c in plan.columns[1:]])
    edge = W.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(edge), F.lit(0)) + F.col("size") / 2
    aside = both.where("bucket <> cut_bucket").withColumn("extra", F.when(F.col("bucket") < F.col("cut_bucket"), 1).otherwise(0))
    at_cut = both.where("bucket = cut_bucket").withColumn("extra", F.when(middle <= F.col("part"), 1).otherwise(0))
    return aside.unionByName(at_cut).withColumn("copies", F.col("whole") + F.col("extra"))
