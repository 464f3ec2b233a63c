"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is dealt into the same number of blocks by a hash. A source's quota is the number of
block draws that its target needs: whole passes over its blocks, then blocks of one more
permutation until the target is met, the last one in part. A binary tree over the output shards
splits the vector of quotas: each node passes its left half a multivariate-hypergeometric draw of
exactly its share of blocks and the rest to the right. A shard draws disjoint runs of each source's
permuted blocks and orders its documents by a hash of its own.

Only one row per source (its size and quotas) reaches the driver; sources are a configured
dimension of a mixture, not a count that follows the documents.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import plain_names, word_count
from corpuskit.plans.durable import cut

SHARDS = 256
SEED = 20240611
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
SUB_BLOCKS = 1024
#: Words of the mix that one task sorts; a larger shard is written in several consecutive pieces.
PIECE_WORDS = 4_000_000
#: Rows of (source, block) that are broadcast at most, about 100 bytes each; with more sources they are joined by shuffle.
BROADCAST_BLOCKS = 200_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Targets of sources in order: ``share`` of all sizes by repeating weights, none above ``limit`` times its size.

    What a stopped target leaves over goes to the others by weight until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [limit * s for s in sizes]
    total, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        unit = max(0.0, rest) / sum(weight[i] for i in free)
        over = [i for i in free if unit * weight[i] > caps[i]]
        if not over:
            for i in free:
                out[i] = unit * weight[i]
            break
        for i in over:
            out[i] = caps[i]
            free.discard(i)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Quotas of each shard: rows sum to each shard's share of all draws, columns exactly to ``quotas``."""
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, np.asarray(quotas, np.int64))]
    while nodes:
        low, high, draws = nodes.pop()
        if high - low == 1:
            out[low] = draws
            continue
        middle, total = (low + high) // 2, int(draws.sum())
        # The borders of a shard's share depend on the node alone, so shares differ by one at most.
        left = total * (middle - low) // (high - low)
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        part = rng.multivariate_hypergeometric(draws, left, method="marginals") if total else draws
        nodes += [(low, middle, part), (middle, high, draws - part)]
    return out


def _running(order: list[Column], *by: str):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """What the mix takes of every row.

    Returns ``doc_id, text_key, size, source_size, target, taken, copies``, one row per input row;
    ``copies`` lists ``(epoch, shard, words)`` of each copy taken, where ``words`` is less than
    ``size`` only for the one document per source at which its target is met. The words taken of a
    source sum exactly to its rounded target.

    Null text has size 0, a null source is a source of its own, last in order; a null id is allowed.
    Repeated rows are dealt like others. Wordless documents follow their block with 0 words. An
    empty input gives no rows.
    """
    d = _design(docs, id_col, text_col, source_col, shards, seed, weights, share, limit)
    rows = d.rows.join(d.per_block, ["sid", "block"], "left")
    columns = ["doc_id", "text_key", "size", "source_size", "target", "draws", "part_take"]
    every = d.part.select(columns).unionByName(rows.where("part_words IS NULL").withColumn("part_take", F.lit(0).cast("long")).select(columns))
    copies = F.expr("filter(transform(coalesce(draws, array()), d -> struct(d.epoch AS epoch, d.shard AS shard, if(d.part, part_take, size) AS words)), d -> d.words > 0 OR size = 0)")
    taken = F.expr("aggregate(copies, 0L, (n, d) -> n + d.words)")
    planned = every.withColumn("copies", copies).withColumn("taken", taken)
    return planned.select("doc_id", "text_key", "size", "source_size", "target", "taken", "copies")


class Design(NamedTuple):
    """What a mix is made of; ``rows`` and ``part`` have a row per input row (of the blocks taken in part)."""

    rows: DataFrame
    sources: DataFrame
    per_block: DataFrame
    part: DataFrame
    n_sources: int
    words: int


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text_key")


def _design(docs: DataFrame, id_col: str, text_col: str, source_col: str, shards: int, seed: int, weights: tuple[float, ...], share: float, limit: float) -> Design:
    spark, blocks = docs.sparkSession, 4 * shards
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_key"))
    rows = cut(base.withColumn("key", _key(seed)).withColumn("block", F.expr(f"int(pmod(key, {blocks}L))")))

    found = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    goals = targets([r.n for r in found], weights, share, limit)
    whole = [min(round(t), math.floor(limit * r.n)) for t, r in zip(goals, found)]
    table = [(i, r.source, r.n, t, w // r.n if r.n else 0, w % r.n if r.n else 0) for i, (r, t, w) in enumerate(zip(found, goals, whole))]
    sources = spark.createDataFrame(table, "sid int, source string, source_size long, target double, passes long, rest long")

    rows = rows.join(sources.select("sid", F.col("source").alias("source2"), "source_size", "target"), F.col("source").eqNullSafe(F.col("source2"))).drop("source", "source2")
    sizes = cut(rows.groupBy("sid", "block").agg(F.sum("size").alias("words")))

    # One row per draw of a block; the last pass of a source is cut where its rest ends.
    passes = sizes.join(sources.select("sid", "passes", "rest"), "sid").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))
    turn = [F.xxhash64(F.lit(seed), "epoch", "sid", "block"), F.col("block")]
    passes = passes.withColumn("before", F.sum("words").over(_running(turn, "sid", "epoch")) - F.col("words"))
    last = F.col("epoch") == F.col("passes")
    draws = passes.withColumn("take", F.when(last, F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before")))).otherwise(F.col("words")))
    draws = draws.where(~last | (F.col("take") > 0)).withColumn("turn", F.row_number().over(Window.partitionBy("sid").orderBy("epoch", *turn)) - 1)
    draws = cut(draws.select("sid", "block", "epoch", "words", "take", "turn"))

    counted = {r.sid: r["count"] for r in draws.groupBy("sid").count().collect()}
    quotas = [counted.get(i, 0) for i in range(len(table))]
    bounds = np.cumsum(split_quotas(quotas, shards, seed), axis=0) if table else np.zeros((shards, 0), np.int64)
    ends = spark.createDataFrame([(i, bounds[:, i].tolist()) for i in range(len(table))], "sid int, ends array<long>")
    draws = draws.join(ends, "sid").withColumn("shard", F.expr("size(filter(ends, e -> e <= turn))")).drop("ends")
    per_block = cut(draws.groupBy("sid", "block").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "shard", (F.col("take") < F.col("words")).alias("part")))).alias("draws"),
        F.max(F.when(F.col("take") < F.col("words"), F.col("take"))).alias("part_words"),
    ))

    # Inside the one block of a source that is taken in part, documents follow in hash order.
    part = rows.join(per_block.where("part_words IS NOT NULL"), ["sid", "block"]).withColumn("sub", F.expr(f"int(pmod(shiftright(key, 32), {SUB_BLOCKS}L))"))
    subs = part.groupBy("sid", "sub").agg(F.sum("size").alias("words"))
    subs = subs.withColumn("sub_before", F.sum("words").over(_running([F.col("sub")], "sid")) - F.col("words")).drop("words")
    part = part.join(subs, ["sid", "sub"])
    order = [F.col(c) for c in ("key", "doc_id", "size", "text_key")]
    before = F.col("sub_before") + F.sum("size").over(_running(order, "sid", "sub")) - F.col("size")
    part = cut(part.withColumn("part_take", F.greatest(F.lit(0), F.least("size", F.col("part_words") - before))))
    return Design(rows, sources, per_block, part, len(table), sum(whole))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, piece_words: int = PIECE_WORDS, whole: bool = False) -> DataFrame:
    """The mixed corpus: a row of ``docs`` for each copy taken, dealt by output shard and shuffled inside it.

    The text of the document at which a source's target is met ends with the last word taken;
    ``n_chars``, where there is such a column, follows. With ``whole`` that copy is taken whole or not
    at all, whichever comes nearer to the target (whole if equal). Columns are those of ``docs``. A shard of more
    than ``piece_words`` words is cut into ranges of its shuffled order, each sorted by a task, so that
    a task's work stays the same as the corpus grows. Repeated rows, and rows that agree in id and text
    alone, are each taken as the plan says of one of them. An empty input gives no rows.

    What is taken of a row follows from its source and block, so texts meet the draws of their block by a
    broadcast (up to ``BROADCAST_BLOCKS`` rows) and are shuffled once, to their shard. Only those of the one block
    per source that is taken in part are looked up one by one.
    """
    docs, named_back = plain_names(docs, [id_col, text_col, source_col, "n_chars"])
    d = _design(docs, id_col, text_col, source_col, shards, seed, weights, share, limit)
    text = F.col(text_col).cast("string")
    names = {"doc_id": F.col(id_col).cast("long"), "text_key": F.xxhash64(text), "source": F.col(source_col).cast("string")}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[c.alias(k) for k, c in names.items()], text.alias("__text"))
    rows = rows.withColumn("__key", _key(seed)).withColumn("block", F.expr(f"int(pmod(__key, {4 * shards}L))"))
    few = d.n_sources * 4 * shards <= BROADCAST_BLOCKS
    blocks = d.per_block.join(d.sources.select("sid", F.col("source").alias("__source")), "sid").withColumnRenamed("block", "__block")
    rows = rows.join(F.broadcast(blocks) if few else blocks, F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block"))).drop("source", "block", "__source", "__block")
    full = rows.where("part_words IS NULL").withColumn("part_take", F.lit(0).cast("long")).withColumn("size", F.lit(0).cast("long"))
    # Rows that agree in id and text are numbered on both sides, so that each gets the take of one of them.
    same = Window.partitionBy("sid", "doc_id", "text_key")
    taken = d.part.withColumn("__nth", F.row_number().over(same.orderBy(F.desc("part_take")))).select(F.col("sid").alias("__sid"), F.col("doc_id").alias("__id"), F.col("text_key").alias("__tk"), "__nth", "size", "part_take")
    part = rows.where("part_words IS NOT NULL").withColumn("__n", F.row_number().over(same.orderBy(F.xxhash64("__row"))))
    alike = (F.col("sid") == F.col("__sid")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__tk"))
    part = part.join(taken, alike & (F.col("__n") == F.col("__nth"))).drop("__n", "__nth", "__sid", "__id", "__tk")
    rows = full.unionByName(part.select(full.columns)).withColumn("__draw", F.explode("draws"))
    # ``words`` is null for a copy taken whole.
    in_part = F.col("__draw.part") & (F.col("part_take") < F.col("size"))
    if whole:
        rows = rows.where(~in_part | (2 * F.col("part_take") >= F.col("size")))
        words = F.lit(None).cast("int")
    else:
        rows = rows.where(~in_part | (F.col("part_take") > 0))
        words = F.when(in_part, F.col("part_take").cast("int"))
    rows = rows.withColumn("__words", words)
    short = F.expr(r"array_join(slice(split(__text, '(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])'), 1, __words), '')")
    rows = rows.withColumn("__text", F.when(F.col("__words").isNotNull(), short))
    rows = rows.withColumn("__order", F.xxhash64(F.lit(seed), "__draw.epoch", "__draw.shard", "doc_id", "text_key")).withColumn("__shard", F.col("__draw.shard"))
    pieces, parts = max(1, math.ceil(d.words / (shards * piece_words))), math.ceil(d.words / piece_words)
    piece = F.floor((F.col("__order").cast("double") / 2.0**64 + 0.5) * pieces)
    rows, keys = rows.withColumn("__piece", F.least(piece, F.lit(pieces - 1))), ["__shard", "__piece"]
    rows = rows.select("__row", "__text", "__words", "__order", *keys)
    if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(parts, *keys)
    else:
        rows = rows.repartition(*keys)
    rows = rows.sortWithinPartitions(*keys, "__order")
    cut_text = {text_col: F.when(F.col("__words").isNull(), F.col(f"__row.`{text_col}`")).otherwise(F.col("__text"))}
    if "n_chars" in docs.columns:
        cut_text["n_chars"] = F.when(F.col("__words").isNull(), F.col("__row.n_chars")).otherwise(F.length("__text").cast(docs.schema["n_chars"].dataType))
    return named_back(rows.select(*[cut_text.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns]))
