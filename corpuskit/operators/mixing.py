"""Weighted, curriculum-scheduled sampling of documents without sequential state.

Draw i hashes to u in [0, 1), which picks a source by cumulative weight; the k-th draw of a source
takes the k-th document of its shuffled order, which is shuffled anew on every wrap. The same seed
gives the same sample whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.functions import arrays as A
from corpuskit.plans.durable import numbered

SEED = 42


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def normalised(weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weights that sum to one (per group); an error if they sum to nothing."""
    total = F.sum("weight").over(Window.partitionBy(*(by or [])))
    checked = F.when(total > 0, F.col("weight") / total).otherwise(F.raise_error(F.lit("Weights must sum to a positive number")).cast("double"))
    return weights.withColumn("weight", checked)


def stages(spark: SparkSession, curriculum: list[dict] | None, defaults: dict[str, float]) -> DataFrame:
    """``(stage, low, high, source, weight)`` of a curriculum; the last stage has no end.

    A stage's weights replace the defaults; a source unknown to ``defaults`` is an error. A stage
    that an earlier one covers entirely has no steps.
    """
    plan, low, rows = curriculum or [{"until_step": None, "weights": defaults}], 0, []
    for i, stage in enumerate(plan):
        high = stage.get("until_step") if i + 1 < len(plan) else None
        unknown = set(stage["weights"]) - set(defaults)
        if unknown:
            raise KeyError(f"unknown sources: {sorted(unknown)}")
        if high is None or high > low:
            rows += [(i, low, high, s, float(w)) for s, w in stage["weights"].items()]
            low = high
        if high is None:
            break
    return spark.createDataFrame(rows, "stage int, low long, high long, source string, weight double")


def thresholds(stage_weights: DataFrame) -> DataFrame:
    """Adds the range ``[from_u, to_u)`` of each source within its stage, sources in order of name."""
    rows = normalised(stage_weights, ["stage"])
    window = Window.partitionBy("stage").orderBy("source")
    to = F.sum("weight").over(window.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("source").over(window).isNull()
    rows = rows.withColumn("to_u", F.when(last, 1.0).otherwise(to))
    return rows.withColumn("from_u", F.coalesce(F.lag("to_u").over(window), F.lit(0.0)))


def weights_at(steps: DataFrame, stage_weights: DataFrame) -> DataFrame:
    """``(step, stage, source, weight)``: normalised weights that hold at each step."""
    rows = normalised(stage_weights, ["stage"])
    inside = (F.col("step") >= F.col("low")) & (F.col("high").isNull() | (F.col("step") < F.col("high")))
    # A curriculum has a few dozen rows by construction, so the range join broadcasts it.
    return steps.join(F.broadcast(rows), inside).select("step", "stage", "source", "weight")


def draws(spark: SparkSession, n: int, stage_weights: DataFrame, seed: int = SEED, per_step: int = 1) -> DataFrame:
    """``(i, step, source)`` of ``n`` draws; ``per_step`` draws share a step."""
    base = spark.range(n).select(F.col("id").alias("i"), F.floor(F.col("id") / per_step).alias("step"))
    base = base.withColumn("u", unit(F.lit(seed), F.lit("s"), F.col("i")))
    t = thresholds(stage_weights)
    inside = (F.col("step") >= F.col("low")) & (F.col("high").isNull() | (F.col("step") < F.col("high")))
    chosen = inside & (F.col("u") >= F.col("from_u")) & (F.col("u") < F.col("to_u"))
    return base.join(F.broadcast(t), chosen).select("i", "step", "source")


def sample(docs: DataFrame, n: int, stage_weights: DataFrame, seed: int = SEED, per_step: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(i, step, source, epoch, doc_id)``: ``n`` documents drawn with replacement across epochs only.

    Numbering of draws and of each epoch's shuffle runs over range partitions, so a source with most
    of the rows is no single task's work.
    """
    drawn = numbered(draws(docs.sparkSession, n, stage_weights, seed, per_step), ["i"], "k", ["source"])
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("size"))
    drawn = drawn.join(sizes, "source").withColumn("epoch", F.floor(F.col("k") / F.col("size"))).withColumn("pos", F.col("k") % F.col("size"))
    epochs = drawn.select("source", "epoch").distinct()
    pool = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id")).join(epochs, "source")
    pool = pool.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string"))))
    pool = numbered(pool, ["key", "doc_id"], "pos", ["source", "epoch"])
    return drawn.join(pool.drop("key"), ["source", "epoch", "pos"]).select("i", "step", "source", "epoch", "doc_id")


def batches(sampled: DataFrame, tokens: DataFrame, batch: int, length: int, id_col: str = "doc_id") -> DataFrame:
    """``(step, slot, source, input_ids, n_real)``: padded rows of training batches."""
    rows = sampled.join(tokens.select(id_col, "tokens"), id_col)
    ids = A.padded(F.col("tokens"), length)
    return rows.select(F.floor(F.col("i") / batch).alias("step"), (F.col("i") % batch).alias("slot"), "source", ids.alias("input_ids")).withColumn("n_real", F.size(F.filter("input_ids", lambda x: x != 0)))


def distribution(sampled: DataFrame) -> DataFrame:
    """Number and share of draws per source."""
    counts = sampled.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("source", "n", (F.col("n") / F.col("total")).alias("share"))


def shuffled_batches(rows: DataFrame, batch: int, seed: int = SEED, id_col: str = "doc_id", drop_last: bool = True) -> DataFrame:
    """Adds ``batch`` in a shuffled order of all rows; an incomplete last batch goes."""
    keyed = rows.withColumn("__key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))
    keyed = numbered(keyed, ["__key", id_col], "__at").withColumn("batch", F.floor(F.col("__at") / batch))
    if drop_last:
        keyed = keyed.where(F.col("batch") < keyed.count() // batch)
    return keyed.drop("__key", "__at")


def cycled(rows: DataFrame, steps: int, order: str = "doc_id") -> DataFrame:
    """``(step, doc_id)``: rows in order, over and over, for ``steps`` steps."""
    indexed = numbered(rows.select(order), [order], "at")
    n = indexed.count()
    if n == 0:
        return rows.sparkSession.range(0).select(F.col("id").alias("step"), F.lit(None).cast(rows.schema[order].dataType).alias(order))
    asked = rows.sparkSession.range(steps).select(F.col("id").alias("step"), (F.col("id") % n).alias("at"))
    return asked.join(indexed, "at").select("step", order)


def resumed(batched: DataFrame, done: int) -> DataFrame:
    """Batches after the first ``done``."""
    return batched.where(F.col("batch") >= done)
