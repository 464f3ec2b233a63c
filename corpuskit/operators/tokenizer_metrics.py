"""Tokenizer quality: fertility, compression, unknown rate and round trips, per domain and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Targets of the report.
MAX_FERTILITY, MAX_UNKNOWN, MIN_ROUND_TRIP = 1.5, 0.001, 0.999


def metrics(rows: DataFrame, by: str = "domain", tokens: str = "tokens", text: str = "text", decoded: str | None = None, unknown: int | None = None) -> DataFrame:
    """Per domain and, with a null key, recomputed on all texts together.

    ``fertility`` is tokens over characters (infinite without any), ``compression`` bytes over
    tokens, ``unk_rate`` a fraction (0 without an unknown id), ``round_trip`` the share decoded exactly.
    """
    n, chars, size = F.sum(F.size(tokens).cast("long")), F.sum(F.length(text).cast("long")), F.sum(F.octet_length(text).cast("long"))
    missing = F.sum(F.size(F.filter(tokens, lambda x: x == unknown)).cast("long")) if unknown is not None else F.lit(0).cast("long")
    right = F.avg(F.when(F.col(decoded) == F.col(text), 1.0).otherwise(0.0)) if decoded else F.lit(None).cast("double")
    sums = rows.rollup(by).agg(n.alias("n_tokens"), chars.alias("n_chars"), size.alias("n_bytes"), missing.alias("n_unk"), right.alias("round_trip"), F.grouping(by).cast("int").alias("is_aggregate"))
    return sums.select(
        by, "is_aggregate", "n_tokens", "n_chars", F.coalesce(F.try_divide("n_tokens", "n_chars"), F.lit(float("inf"))).alias("fertility"),
        F.coalesce(F.try_divide("n_bytes", "n_tokens"), F.lit(0.0)).alias("compression"), F.coalesce(F.try_divide("n_unk", "n_tokens"), F.lit(0.0)).alias("unk_rate"), "round_trip",
    )


def compare(base: DataFrame, merged: DataFrame, by: str = "domain") -> DataFrame:
    """Fertility and compression of two tokenizers side by side, with differences."""
    pick = lambda df, p: df.where("is_aggregate = 0").select(by, F.col("fertility").alias(f"{p}_fertility"), F.col("compression").alias(f"{p}_compression"))
    joined = pick(base, "base").join(pick(merged, "merged"), by, "full")
    return joined.withColumn("fertility_delta", F.col("merged_fertility") - F.col("base_fertility")).withColumn("compression_delta", F.col("merged_compression") - F.col("base_compression"))


def verdicts(table: DataFrame) -> DataFrame:
    """Macro averages over domains and whether they meet the targets."""
    rows = table.where("is_aggregate = 0").agg(F.avg("fertility").alias("fertility"), F.avg("unk_rate").alias("unk_rate"), F.avg("round_trip").alias("round_trip"))
    grade = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    return rows.select(
        "*", grade(F.col("fertility") < MAX_FERTILITY).alias("fertility_verdict"), grade(F.col("unk_rate") < MAX_UNKNOWN).alias("unk_verdict"),
        grade(F.coalesce(F.col("round_trip") > MIN_ROUND_TRIP, F.lit(False))).alias("round_trip_verdict"),
    )
