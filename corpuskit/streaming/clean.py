"""Cleaning and filtering as a stream: both are stateless, so the batch expressions run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.functions import text as T
from corpuskit.operators import quality
from corpuskit.sources.readers import parse_jsonl


def read(spark: SparkSession, folder: str, schema: str = "text STRING, source STRING") -> DataFrame:
    """JSONL files as they arrive; malformed lines are passed over."""
    return parse_jsonl(spark.readStream.text(folder), schema).select("row.*")


def cleaned(stream: DataFrame, min_ratio: float = 0.3, script: str = T.CJK, limits: quality.Limits = quality.Limits()) -> DataFrame:
    """Cleaned rows with their rejection reason."""
    return quality.with_reason(quality.clean_filter(stream, min_ratio, script), limits)


def write(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once, and ends when all files at hand are done."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def exact_dedup(stream: DataFrame, ts: str, delay: str = "1 day", text_col: str = "text") -> DataFrame:
    """First row of each text within a watermark; state is bounded by the delay."""
    keyed = stream.withColumn("__key", F.md5(text_col))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
