"""Perplexity from per-token losses in strided windows, and its aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(rows: DataFrame, n_col: str = "n_tokens", window: int = 1024, stride: int = 512, legacy: bool = False) -> DataFrame:
    """Explodes each sequence into ``begin, end, first, scored, counted`` of its windows.

    Tokens ``first`` to ``end - 1`` are scored, so that every token but the first of the sequence
    is scored exactly once. With ``legacy``, windows after the first score their last token alone
    but count all their tokens from ``begin`` on, a known flaw kept for comparison.
    """
    n = F.col(n_col)
    # A window starts at each stride until one reaches the end; the last start is the least that does.
    last = F.greatest(F.lit(0), F.ceil((n - window) / stride)) * stride
    out = rows.where(n > 1).withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long"))))
    out = out.withColumn("end", F.least(F.col("begin") + window, n))
    first = F.when(F.col("begin") == 0, F.lit(1))
    if legacy:
        out = out.withColumn("first", first.otherwise(F.col("end") - 1))
        counted = F.when(F.col("begin") == 0, F.col("end") - 1).otherwise(F.col("end") - F.greatest("begin", F.lit(stride)))
    else:
        out = out.withColumn("first", first.otherwise(F.col("begin") - stride + window))
        counted = F.col("end") - F.col("first")
    return out.withColumn("scored", F.col("end") - F.col("first")).withColumn("counted", counted).where("counted > 0")


def exp_or_inf(mean_loss: Column) -> Column:
    """exp of a mean loss, infinite from 100 on or for none."""
    return F.when(mean_loss < 100, F.exp(mean_loss)).otherwise(F.lit(float("inf")))


def perplexities(rows: DataFrame, losses: str = "losses", tokens: str = "n_tokens", chars: str = "n_chars", window: int = 1024, stride: int = 512, legacy: bool = False) -> DataFrame:
    """Adds ``total_nll, n_scored, token_perplexity, char_perplexity``.

    ``losses`` holds the loss of each token given those before it in its window, position 0 included.
    Every token is in one window's scored range, so no window rows are made: the documented rule sums
    positions 1 on; ``legacy`` sums the first window and then the last token of each later one.
    """
    n = F.col(tokens)
    if not legacy:
        total = F.aggregate(F.slice(losses, 2, F.greatest(n - 1, F.lit(1)).cast("int")), F.lit(0.0), lambda s, x: s + x)
        counted = n - 1
    else:
        last = (F.greatest(F.lit(0), F.ceil((n - window) / stride))).cast("int")
        head = F.aggregate(F.slice(losses, 2, F.greatest(F.least(n, F.lit(window)) - 1, F.lit(1)).cast("int")), F.lit(0.0), lambda s, x: s + x)
        ends = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.least(k * stride + window, n))).otherwise(F.array().cast("array<long>"))
        total = head + F.aggregate(ends, F.lit(0.0), lambda s, e: s + F.get(F.col(losses), (e - 1).cast("int")))
        later = F.aggregate(F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(0).cast("long"), lambda s, k: s + F.least(k * stride + window, n) - k * stride)
        counted = F.least(n, F.lit(window)) - 1 + later
    some = n > 1
    rows = rows.withColumn("total_nll", F.when(some, total).otherwise(0.0)).withColumn("n_scored", F.when(some, counted).otherwise(0).cast("long"))
    token = exp_or_inf(F.try_divide("total_nll", "n_scored"))
    return rows.withColumn("token_perplexity", token).withColumn("char_perplexity", exp_or_inf(F.try_divide(F.col("total_nll"), F.col(chars))))


def summary(rows: DataFrame, by: str = "test_set") -> DataFrame:
    """Mean and population deviation per set and, with a null key, over all texts; infinite ones are left out."""
    fine = rows.where(F.col("token_perplexity") < float("inf"))
    return fine.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("token_perplexity").alias("mean_token"), F.stddev_pop("token_perplexity").alias("std_token"),
        F.avg("char_perplexity").alias("mean_char"), F.stddev_pop("char_perplexity").alias("std_char"), F.grouping(by).cast("int").alias("is_overall"),
    )
