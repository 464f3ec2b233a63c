"""Counts of values in the order of a counter: most frequent first, equally frequent ones as first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.plans.durable import numbered


def first_seen_counts(rows: DataFrame, value: Column | str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``(*by, value, n, first)``: how often each value stands, and the place of its first row.

    ``order`` names the columns that say which row is first, such as file and line; the least of them
    is carried through the aggregation, so rows are never sorted.
    """
    kept = F.struct(*[F.col(c) for c in order])
    value = F.col(value) if isinstance(value, str) else value
    return rows.groupBy(*(by or []), value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(kept).alias("first"))


def most_common(rows: DataFrame, value: Column | str, order: list[str], n: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``(*by, value, n, rank)``, ranks from 1 in the whole table or in each group; the first ``n`` if given.

    Null is a value like any other. Ranks are given by ranges of the order, not in one task.
    """
    counts = first_seen_counts(rows, value, order, by).withColumn("falling", -F.col("n"))
    ranked = numbered(counts, ["falling", "first"], "rank", by).withColumn("rank", F.col("rank") + 1)
    ranked = ranked.select(*(by or []), "value", "n", "rank")
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def reason_counts(judged: DataFrame, order: list[str]) -> DataFrame:
    """``(value, n, rank)`` of the reasons for which rows were rejected."""
    return most_common(judged.where("reason IS NOT NULL"), "reason", order)
