"""Training-log and checkpoint analytics: schedules, running losses, retention, vectors, expert load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.plans.durable import cut, numbered

# Default schedules of the two stages.
STAGE1 = {"peak": 1e-3, "low": 1e-4, "warmup": 500, "steps": 5_000}
STAGE2 = {"peak": 1e-5, "low": 1e-6, "warmup": 1_000, "steps": 200_000}


def warmup_cosine(step: Column, peak: float, low: float, warmup: int, steps: int) -> Column:
    """Linear from 0 to ``peak`` over the warm-up, then a half cosine down to ``low``."""
    progress = F.least((step - warmup) / max(1, steps - warmup), F.lit(1.0))
    return F.when(step < warmup, peak * step / max(1, warmup)).otherwise(low + 0.5 * (peak - low) * (1 + F.cos(F.pi() * progress)))


def two_stages(spark: SparkSession, first: int, second: int, one: dict = STAGE1, two: dict = STAGE2) -> DataFrame:
    """``(global_step, stage, step, lr)``: ``first`` steps of stage 1, then ``second`` of stage 2 from its step 0."""
    a = spark.range(first).select(F.col("id").alias("global_step"), F.lit(1).alias("stage"), F.col("id").alias("step"), warmup_cosine(F.col("id"), **one).alias("lr"))
    b = spark.range(second).select((F.col("id") + first).alias("global_step"), F.lit(2).alias("stage"), F.col("id").alias("step"), warmup_cosine(F.col("id"), **two).alias("lr"))
    return a.unionByName(b)


def interval_means(log: DataFrame, every: int, step: str = "step", value: str = "loss") -> DataFrame:
    """Mean of each block of ``every`` steps, steps counted from 1."""
    return log.groupBy(F.floor((F.col(step) - 1) / every).alias("block")).agg(F.avg(value).alias("mean"), F.max(step).alias("last_step"))


#: Rows of a run that one task orders.
BLOCK = 100_000


def moving(log: DataFrame, run: str, step: str = "step", value: str = "loss", last: int = 10) -> DataFrame:
    """Adds ``trailing_mean`` of the last steps and ``best_so_far``, per run.

    Rows are numbered by range partitions and dealt in blocks; a block also gets the last rows before it
    and the least value of all blocks before it, so a long run is not ordered by one task. Steps of a run
    are distinct.
    """
    rows = cut(numbered(log, [step], "__i", [run]).withColumn("__block", F.floor(F.col("__i") / BLOCK)))
    lows = rows.groupBy(run, "__block").agg(F.min(value).alias("__low"))
    before = Window.partitionBy(run).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(F.col(run).alias("__run"), F.col("__block").alias("__b"), F.min("__low").over(before).alias("__low"))
    tail = rows.where(F.col("__i") % BLOCK > BLOCK - last).withColumn("__block", F.col("__block") + 1)
    every = rows.withColumn("__own", F.lit(True)).unionByName(tail.withColumn("__own", F.lit(False)))
    order = Window.partitionBy(run, "__block").orderBy("__i")
    every = every.withColumn("trailing_mean", F.avg(value).over(order.rowsBetween(1 - last, 0)))
    every = every.withColumn("best_so_far", F.min(F.when(F.col("__own"), F.col(value))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    every = every.where("__own").join(lows, F.col(run).eqNullSafe(F.col("__run")) & (F.col("__block") == F.col("__b")))
    return every.withColumn("best_so_far", F.least("best_so_far", "__low")).drop("__i", "__block", "__own", "__run", "__b", "__low")


def retention(listing: DataFrame, keep_last: int = 5, name: str = "name", is_best: str = "is_best") -> DataFrame:
    """Adds ``remove``: checkpoints before the last ``keep_last`` by name, but never the best one."""
    rank = numbered(listing, [name], "__at")
    rank = rank.withColumn("remove", (F.col("__at") < F.lit(listing.count() - keep_last)) & ~F.coalesce(is_best, F.lit(False)))
    return rank.drop("__at")


def tag_best(listing: DataFrame, step: int) -> DataFrame:
    """Moves the only best mark to a step."""
    return listing.withColumn("is_best", F.col("name") == f"step_{step}")


def latest(listing: DataFrame) -> DataFrame:
    """The checkpoint with the highest step number, ``step_1000`` after ``step_200``."""
    return listing.withColumn("step", F.expr("try_cast(regexp_extract(name, '^step_([0-9]+)$', 1) AS long)")).where("step IS NOT NULL").orderBy(F.desc("step")).limit(1)


def mean_vector(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """``(dim, mean)``: mean of each component over all rows, partially aggregated per component."""
    return rows.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def new_rows(rows: DataFrame, n: int, sigma: float = 0.0, seed: int = 0, vec: str = "embedding") -> DataFrame:
    """``(row, embedding)``: ``n`` new vectors at the mean plus normal noise of deviation ``sigma``."""
    means = mean_vector(rows, vec).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda x: x.mean).alias("means"))
    out = rows.sparkSession.range(n).select(F.col("id").alias("row")).join(F.broadcast(means))
    if sigma == 0:
        return out.select("row", F.col("means").alias("embedding"))
    # Box-Muller from hashes, so that the noise is the same whatever the partitioning.
    u = lambda i, k: (F.pmod(F.xxhash64(F.lit(seed), "row", i, F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = lambda i: F.sqrt(-2 * F.log(u(i, 1))) * F.cos(2 * F.pi() * u(i, 2))
    return out.select("row", F.transform("means", lambda x, i: x + sigma * noise(i)).alias("embedding"))


def routed(gates: DataFrame, k: int, token: str = "token", expert: str = "expert", score: str = "score") -> DataFrame:
    """``(token, expert, weight)``: each token's ``k`` best experts and their softmax scores, normalised to sum to 1; the first expert wins a tie."""
    order, total = Window.partitionBy(token).orderBy(F.desc(score), expert), Window.partitionBy(token)
    rows = gates.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= k)
    rows = rows.withColumn("weight", F.exp(F.col(score) - F.max(score).over(total)))
    return rows.select(token, expert, (F.col("weight") / F.sum("weight").over(total)).alias("weight"))


def expert_load(gates: DataFrame, k: int, token: str = "token", expert: str = "expert", score: str = "score") -> DataFrame:
    """``(expert, f, p)``: share of routed tokens (times experts over k) and mean softmax score of each expert."""
    order = Window.partitionBy(token).orderBy(F.desc(score), expert)
    total = Window.partitionBy(token)
    rows = gates.withColumn("p", F.exp(F.col(score) - F.max(score).over(total)))
    rows = rows.withColumn("p", F.col("p") / F.sum("p").over(total)).withColumn("routed", (F.row_number().over(order) <= k).cast("int"))
    n = rows.agg(F.count_distinct(token).alias("n"), F.count_distinct(expert).alias("e"))
    sums = rows.groupBy(expert).agg(F.sum("routed").alias("routed"), F.sum("p").alias("p"))
    return sums.join(F.broadcast(n)).select(expert, (F.col("routed") * F.col("e") / (F.col("n") * k)).alias("f"), (F.col("p") / F.col("n")).alias("p"))


def balance_loss(load: DataFrame) -> DataFrame:
    return load.agg(F.sum(F.col("f") * F.col("p")).alias("balance"))


# Fields of a model's configuration and their defaults.
MODEL = {
    "vocab_size": 145408, "dim": 7168, "inter_dim": 18432, "moe_inter_dim": 2048, "n_layers": 61, "n_dense_layers": 1, "n_heads": 128, "n_routed_experts": 256,
    "n_shared_experts": 1, "n_activated_experts": 8, "route_scale": 2.5, "q_lora_rank": 1536, "kv_lora_rank": 512, "qk_nope_head_dim": 128, "qk_rope_head_dim": 64,
    "v_head_dim": 128, "dtype": "bfloat16", "max_seq_len": 4096, "rope_theta": 10000.0,
}


def model_config(configs: DataFrame, text_col: str = "config") -> DataFrame:
    """Fields of JSON configurations with their defaults and two derived head sizes; unknown keys are ignored."""
    kinds = {int: "long", float: "double", str: "string"}
    rows = configs.withColumn("__c", F.from_json(text_col, ", ".join(f"{k} {kinds[type(v)]}" for k, v in MODEL.items())))
    rows = rows.select(*configs.columns, *[F.coalesce(F.col(f"__c.{k}"), F.lit(v)).alias(k) for k, v in MODEL.items()])
    return rows.withColumn("qk_head_dim", F.col("qk_nope_head_dim") + F.col("qk_rope_head_dim")).withColumn("head_dim", F.col("v_head_dim"))


def result_totals(results: DataFrame) -> DataFrame:
    """``(status, n, elapsed)`` of test results ``(passed, skipped, elapsed)``; skipped ones neither pass nor fail."""
    status = F.when(F.col("skipped"), "SKIP").when(F.col("passed"), "PASS").otherwise("FAIL")
    return results.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed").alias("elapsed"))


def usage(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``prompt_tokens, completion_tokens, total_tokens`` of calls ``(prompt_tokens, completion_tokens)``, added up."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    return calls.groupBy(*(by or [])).agg(*sums).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def last_wins(shards: DataFrame, key: str = "name", order: str = "shard") -> DataFrame:
    """One row per key from the last shard that has it."""
    rest = [c for c in shards.columns if c != key]
    return shards.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
