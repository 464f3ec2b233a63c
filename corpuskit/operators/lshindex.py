"""Near-duplicates over batches: a stored index of the band buckets of the documents that stay.

A batch is signed and compared with the buckets of all earlier batches, then with itself, first
occurrence first; what stays joins the index. Earlier texts and signatures are never read again.
The index is a Parquet table, partitioned by batch and bucketed by the buckets' names, so a probe
shuffles the batch and not the index. A batch that is added again replaces what it added before and
sees only batches before it, so a repeated or restarted run gives the same rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators import neardup
from corpuskit.plans.durable import cut

#: Files that a batch adds at most; a task of a probe reads a bucket of all batches.
BUCKETS = 64


class LshIndex:
    """The index in ``folder``, which every executor reaches; made there if it is new.

    ``scope`` names a column within whose values documents are compared, a null one being a value
    of its own; without it all are. Parameters other than those an index was made with are an error.
    """

    def __init__(self, spark: SparkSession, folder: str, scope: str | None = None, threshold: float = 0.8, permutations: int = neardup.PERMUTATIONS, n: int = neardup.SHINGLE, buckets: int = BUCKETS):
        self.folder, self.scope, self.threshold, self.permutations, self.n, self.buckets = folder, scope, threshold, permutations, n, buckets
        self.name = f"lsh_{hashlib.md5(folder.encode()).hexdigest()}"
        self._check(spark)
        self._open(spark)

    def _check(self, spark: SparkSession) -> None:
        own = (self.scope, float(self.threshold), self.permutations, self.n, self.buckets)
        kind = "scope string, threshold double, permutations int, n int, buckets int"
        spark.createDataFrame([own], kind).write.mode("ignore").json(f"{self.folder}/parameters")
        stored = spark.read.schema(kind).json(f"{self.folder}/parameters").first()
        if stored is None:  # a first run ended before it wrote them
            spark.createDataFrame([own], kind).write.mode("overwrite").json(f"{self.folder}/parameters")
        elif tuple(stored) != own:
            raise ValueError(f"the index was made with {stored.asDict()}")

    def _open(self, spark: SparkSession) -> None:
        """Names the files in this session's catalog, which may be a new one's."""
        kind = "k1 BIGINT, k2 BIGINT, n BIGINT, batch BIGINT"
        spark.createDataFrame([], kind).write.mode("ignore").partitionBy("batch").parquet(f"{self.folder}/bands")  # the folder alone
        clustered = f"PARTITIONED BY (batch) CLUSTERED BY (k1, k2) INTO {self.buckets} BUCKETS"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({kind}) USING parquet {clustered} LOCATION '{self.folder}/bands'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def bands(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """``(k1, k2, n, batch)``: a row per bucket, in which no two documents that stay meet."""
        rows = spark.table(self.name)
        return rows if before is None else rows.where(F.col("batch") < before)

    def memberships(self, docs: DataFrame, order: str, text_col: str) -> tuple[DataFrame, DataFrame]:
        scope = [self.scope] if self.scope else []
        signed = cut(neardup.signatures(docs, [order, *scope], text_col, self.n, self.permutations))
        nodes, members = neardup.memberships(signed, order, scope, self.threshold, self.permutations)
        return nodes, cut(members)

    def hits(self, docs: DataFrame, order: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(<order>, kept)``: documents that meet indexed ones and the least of these, without adding anything."""
        nodes, members = self.memberships(docs, order, text_col)
        return members.join(self.bands(docs.sparkSession).withColumnRenamed("n", "kept"), ["k1", "k2"]).groupBy(F.col("n").alias(order)).agg(F.min("kept").alias("kept"))

    def add(self, batch: int, docs: DataFrame, order: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Ids of the batch's documents that stay, now in the index.

        ``order`` is a whole number, distinct in the batch, and says who is first in it; earlier batches
        are before all. Rows without text are neither kept nor duplicates. An empty batch is one too.
        """
        spark = docs.sparkSession
        nodes, members = self.memberships(docs, order, text_col)
        met = cut(members.join(self.bands(spark, batch), ["k1", "k2"], "left_semi").select(F.col("n").alias("met")).distinct())
        fresh = cut(members.join(met, F.col("n") == F.col("met"), "left_anti"))
        kept = cut(neardup.first_wins(nodes.join(met, F.col(order) == F.col("met"), "left_anti"), fresh, order))
        rows = fresh.join(kept.withColumnRenamed(order, "kept"), F.col("n") == F.col("kept"), "left_semi")
        rows = rows.select("k1", "k2", F.col("n").cast("long").alias("n")).repartition(self.buckets, "k1", "k2")
        spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {int(batch)}) SELECT k1, k2, n FROM {{rows}}", rows=rows)
        return kept

    def keep(self, batch: int, docs: DataFrame, order: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The batch's documents that stay, in all columns."""
        return docs.join(self.add(batch, docs, order, text_col), order, "left_semi")
