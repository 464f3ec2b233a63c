"""Cuts of lineage, and orderings and running sums over a whole table without a single-task window."""

from __future__ import annotations

import itertools
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of totals that are broadcast at most.
BROADCAST = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and all runs on this machine, as in tests."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuskit-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder and reads it back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list[str], values: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Adds running totals in ``order``: ``values`` maps new columns to summed expressions.

    Rows are range-partitioned by ``by`` and ``order``; each partition sums its own rows and the
    totals of the partitions before it are added. The totals, a row for each partition and each ``by``
    group in it, stay in a table, which is broadcast up to ``BROADCAST`` rows. ``order`` must make rows
    distinct for a repeatable result.
    """
    by = by or []
    keys = [*by, *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *[F.col(k) for k in keys]).withColumn("__part", F.spark_partition_id()))
    inner = Window.partitionBy("__part", *by).orderBy(*[F.col(k) for k in order]).rowsBetween(Window.unboundedPreceding, 0)
    # Without groups the table has a row per partition, few enough for one window.
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__part", *by).agg(*[F.sum(F.expr(e)).alias(f"__t_{n}") for n, e in values.items()])
    bases = [F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values]
    starts = cut(sums.select(F.col("__part").alias("__part2"), *[F.col(b).alias(f"__by_{b}") for b in by], *bases))
    on = F.col("__part") == F.col("__part2")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    for n, e in values.items():
        rows = rows.withColumn(n, F.sum(F.expr(e)).over(inner))
    rows = rows.join(F.broadcast(starts) if starts.count() <= BROADCAST else starts, on)
    for n in values:
        rows = rows.withColumn(n, F.col(n) + F.col(f"__b_{n}"))
    return rows.drop("__part", "__part2", *[f"__by_{b}" for b in by], *[f"__b_{n}" for n in values])


def numbered(df: DataFrame, order: list[str], name: str = "row", by: list[str] | None = None) -> DataFrame:
    """Adds 0-based row numbers in ``order``, over the whole table or per group."""
    return running(df, order, {name: "1L"}, by).withColumn(name, F.col(name) - 1)


def stages(spark: SparkSession, table: list[tuple], schema: str) -> DataFrame:
    """A small table from driver values."""
    return spark.createDataFrame(list(itertools.chain(table)), schema)
