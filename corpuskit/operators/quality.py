"""Cleaning and quality filters with an auditable reason for each rejected row, and their statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T


@dataclass(frozen=True)
class Limits:
    """Bounds of the quality filter, inclusive."""

    min_len: int = 50
    max_len: int = 500_000
    min_ratio: float = 0.3
    ngram: int = 10
    max_repeat: float = 0.2
    min_line: float = 10.0
    max_line: float = 10_000.0
    script: str = T.CJK


def repetition_of(text: str | None, n: int) -> float | None:
    """Share of the most frequent character n-gram; 0 for a text shorter than n."""
    if text is None:
        return None
    total = len(text) - n + 1
    if total < 1:
        return 0.0
    # 64-bit hashes of all n-grams at once; equal ones stand together when sorted.
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    grams = np.zeros(total, np.uint64)
    for i in range(n):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + codes[i : i + total]
    grams.sort()
    ends = np.append(np.nonzero(grams[1:] != grams[:-1])[0], total - 1)
    return int(np.diff(ends, prepend=-1).max()) / total


def repetition(text: Column, n: int = 10) -> Column:
    """``repetition_of`` as an Arrow function: n-grams by substring would be quadratic in the JVM."""

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: repetition_of(x, n)).astype("float64")

    # Else a filter on the result would be moved below the projection and compute it a second time.
    return ratio.asNondeterministic()(text)


def mean_line(text: Column) -> Column:
    """Mean length of the lines that are not blank; null if there is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{T.PYWS}]"))
    return F.try_divide(F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x)), F.size(lines))


def clean_filter(docs: DataFrame, min_ratio: float = 0.3, script: str = T.CJK, text_col: str = "text") -> DataFrame:
    """Cleaned documents: rows without text before or after cleaning, or with too little of the script, go."""
    docs = docs.where(F.coalesce(F.length(text_col), F.lit(0)) > 0)
    fine = lambda x: (F.length(x) > 0) & (T.script_ratio(x, script) >= min_ratio)
    # Else a filter on the cleaned text would be moved below the projection and clean again for each of its tests.
    return docs.withColumn(text_col, F.explode(F.filter(F.array(T.clean(F.col(text_col))), fine)))


def with_reason(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """Adds ``reason``: the first failed of length, cjk_ratio, repetition, mean_line_length; null if all pass.

    Null text fails as ``length``. JVM tests come first; the Arrow function sees only the texts
    that passed them (others reach it as null).
    """
    text = F.col(text_col)
    early = F.when(~F.coalesce(F.length(text).between(limits.min_len, limits.max_len), F.lit(False)), "length").when(T.script_ratio(text, limits.script) < limits.min_ratio, "cjk_ratio")
    docs = docs.withColumn("reason", early)
    docs = docs.withColumn("__rep", repetition(F.when(F.col("reason").isNull(), text), limits.ngram))
    line = mean_line(text)
    late = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("__rep") > limits.max_repeat, "repetition")
    late = late.when(~F.coalesce(line.between(limits.min_line, limits.max_line), F.lit(False)), "mean_line_length")
    return docs.withColumn("reason", late).drop("__rep")


def keep(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """Rows that pass every test."""
    return with_reason(docs, limits, text_col).where("reason IS NULL").drop("reason")


def reason_counts(judged: DataFrame) -> DataFrame:
    """``(reason, n)`` by falling count; passed rows have reason ``kept``."""
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def filter_stats(judged: DataFrame, by: str = "source") -> DataFrame:
    """Per file and, with a null key, over all: total, kept, filtered, filter_rate."""
    total, kept = F.count(F.lit(1)), F.count_if(F.col("reason").isNull())
    stats = judged.rollup(by).agg(total.alias("total"), kept.alias("kept"), F.grouping(by).cast("int").alias("is_summary"))
    return stats.withColumn("filtered", F.col("total") - F.col("kept")).withColumn("filter_rate", F.try_divide("filtered", "total"))


def clean_stats(lines: DataFrame, kept: DataFrame, by: str = "source") -> DataFrame:
    """Statistics of cleaning: total counts every raw line, blank and malformed ones too."""
    total = lines.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    left = kept.groupBy(by).agg(F.count(F.lit(1)).alias("kept"))
    stats = total.join(left, by, "left").select(by, "total", F.coalesce("kept", F.lit(0)).alias("kept"))
    return stats.withColumn("filtered", F.col("total") - F.col("kept")).withColumn("filter_rate", F.try_divide("filtered", "total"))


def first_long(docs: DataFrame, min_len: int, n: int, order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first ``n`` rows whose text has ``min_len`` characters or more."""
    return docs.where(F.length(text_col) >= min_len).orderBy(order).limit(n)
