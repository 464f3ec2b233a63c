"""Idempotent ingest of corpora: a stream with a ledger of batches and a Bloom filter of the texts taken.

A batch writes its new texts, their keys and its share of the filter in folders of its own, and last
a row of the ledger. A batch in the ledger is passed over; one that ended before it is done again and
replaces what it left. The filter, of a fixed size, is broadcast: a text that it does not know
is new without a look at the keys; the others, few while it is not full, are looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.functions import text as T
from corpuskit.plans.durable import cut
from corpuskit.sources import readers

#: Bits of the filter (16 MB); a power of two. It stays exact beyond any number of keys, only slower.
BITS = 1 << 27
HASHES = 5
KEYS = "k1 long, k2 long"


def _places(k1: np.ndarray, k2: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys in the filter, a row each."""
    a, b = k1.astype(np.uint64), k2.astype(np.uint64) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]) & np.uint64(bits - 1)


def key(text: Column) -> list[Column]:
    """A text's key, two hashes."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


class Ingest:
    """Corpora of JSONL rows in ``folder``, a URI that every executor reaches."""

    def __init__(self, folder: str, bits: int = BITS):
        if bits < 64 or bits & (bits - 1):
            raise ValueError("bits must be a power of two of 64 or more")
        self.folder, self.bits = folder, bits

    def _stored(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """A part of the state; a first write makes its folder, so an empty one is made here."""
        path = f"{self.folder}/{name}"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")
        return spark.read.schema(f"{schema}, batch long").parquet(path).where("batch >= 0")

    def ledger(self, spark: SparkSession) -> DataFrame:
        """``(documents, batch)`` of every batch that is done."""
        return self._stored(spark, "ledger", "documents long")

    def _committed(self, spark: SparkSession, name: str, schema: str, done: list[int]) -> DataFrame:
        return self._stored(spark, name, schema).where(F.col("batch").isin(done))

    def _filter(self, spark: SparkSession, done: list[int]) -> np.ndarray:
        """Words of the filter over all batches that are done; ``bits / 64`` rows reach the driver at most."""
        words = np.zeros(self.bits // 64, np.uint64)
        rows = self._committed(spark, "filter", "word long, bits long", done).groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        return words

    def _maybe_seen(self, spark: SparkSession, done: list[int]) -> Column:
        shared, bits = spark.sparkContext.broadcast(self._filter(spark, done)), self.bits

        @F.pandas_udf("boolean")
        def test(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            words = shared.value
            for k1, k2 in batches:
                at = _places(k1.to_numpy(), k2.to_numpy(), bits)
                yield pd.Series((words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1))

        return test("k1", "k2")

    def _bits_of(self, keys: DataFrame) -> DataFrame:
        """``(word, bits)``: the filter of keys, words without a bit left out."""
        bits = self.bits

        @F.pandas_udf("array<bigint>")
        def places(k1: pd.Series, k2: pd.Series) -> pd.Series:
            return pd.Series(list(_places(k1.to_numpy(), k2.to_numpy(), bits).astype(np.int64)))

        each = keys.select(F.explode(places("k1", "k2")).alias("at"))
        return each.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))

    def add(self, batch: int, rows: DataFrame, text_col: str = "text", source_col: str = "source") -> int:
        """Adds the batch's texts that no batch before has; how many, or what the ledger has if it is done already.

        Texts are stripped; those without any go, and of repeated ones in a batch one stays, that of
        the first source by name. The batch's number says which others come before.
        """
        spark = rows.sparkSession
        done = {r.batch: r.documents for r in self.ledger(spark).collect()}
        if batch in done:
            return done[batch]
        before = [b for b in done if b < batch]
        text = T.strip(F.col(text_col))
        fresh = rows.select(text.alias("text"), F.col(source_col).cast("string").alias("source")).where("text <> ''").select("text", "source", *key(F.col("text")))
        fresh = cut(fresh.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.min("source").alias("source")).withColumn("maybe", self._maybe_seen(spark, before)))
        keys = self._committed(spark, "keys", KEYS, before).select("k1", "k2")
        seen = cut(fresh.where("maybe").select("k1", "k2").join(keys, ["k1", "k2"], "left_semi"))
        new = cut(fresh.join(seen, ["k1", "k2"], "left_anti"))
        readers.write_jsonl(new.select("text", "source"), f"{self.folder}/documents/batch={batch}")
        new.select("k1", "k2").write.mode("overwrite").parquet(f"{self.folder}/keys/batch={batch}")
        self._bits_of(new).write.mode("overwrite").parquet(f"{self.folder}/filter/batch={batch}")
        count = new.count()
        spark.createDataFrame([(count,)], "documents long").write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        return count

    def documents(self, spark: SparkSession) -> DataFrame:
        """``(text, source, batch)`` of all batches that are done."""
        done = [r.batch for r in self.ledger(spark).collect()]
        paths = [f"{self.folder}/documents/batch={b}" for b in done]
        if not paths:
            return spark.createDataFrame([], "text string, source string, batch long")
        return spark.read.schema("text string, source string, batch long").option("basePath", f"{self.folder}/documents").json(paths)

    def stream(self, rows: DataFrame, checkpoint: str, text_col: str = "text", source_col: str = "source") -> StreamingQuery:
        """Adds a stream's rows, a batch for each micro-batch, and ends when all at hand is done."""

        def run(part: DataFrame, number: int) -> None:
            self.add(number, part, text_col, source_col)

        return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def source_stream(spark: SparkSession, name: str, root: str, registry: dict[str, readers.SourceSpec] = readers.REGISTRY, files: int | None = None) -> DataFrame:
    """A registered corpus as a stream of ``(text, source)``; ``files`` is how many a micro-batch takes at most."""
    spec = registry[name]
    path = f"{root}/{spec.path}"
    reader = spark.readStream.format(spec.format).options(**spec.options).schema(spark.read.format(spec.format).options(**spec.options).load(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(path).select(F.col(spec.text_field).alias("text"), F.lit(name).alias("source"))
