"""Duplicates in streams: near ones by the stored index, exact ones by state per text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from corpuskit.operators.lshindex import LshIndex
from corpuskit.plans.durable import cut


def near_dedup(stream: DataFrame, index: LshIndex, out: str, checkpoint: str, order: str = "doc_id", text_col: str = "text", first_batch: int = 0) -> StreamingQuery:
    """Writes the documents of a stream that stay, a folder of Parquet for each micro-batch, and ends when all at hand is done.

    The first occurrence wins over all micro-batches. Index and output are replaced by micro-batch,
    so one that ran in part and runs again after a restart from the checkpoint leaves no row twice.
    ``first_batch`` numbers the first micro-batch where the index has batches from before the stream.
    """

    def run(rows: DataFrame, number: int) -> None:
        rows = cut(rows)
        kept = index.keep(first_batch + number, rows, order, text_col)
        kept.write.mode("overwrite").parquet(f"{out}/batch={first_batch + number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _First(StatefulProcessor):
    """Per text: the order of its first occurrence."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("first", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Rows of a micro-batch come in any order; a text seen before lets none through.
        if self.seen.exists():
            return
        first = min(int(part[self.order].min()) for part in rows)
        self.seen.update((first,))
        yield pd.DataFrame({self.order: [first]})


def first_of_text(stream: DataFrame, order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<order>)`` of the first row of each text over all micro-batches, the smallest of those in one.

    State is a number per distinct text, in RocksDB, keyed by the text's digest, and only order and
    digest are shuffled. Null is a text of its own. Needs the RocksDB state store provider.
    """
    keyed = stream.select(F.col(order).cast("long").alias(order), F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")).alias("digest"))
    return keyed.groupBy("digest").transformWithStateInPandas(_First(order), StructType([StructField(order, LongType())]), outputMode="append", timeMode="none")
