"""Shuffled cursors over the documents of a source by a keyed permutation.

An epoch's order is never sorted or stored. The documents of a source have row numbers, given once;
a Feistel network over the bits of the row numbers, keyed by seed, source and epoch, is a permutation
of a power of two, and values beyond the source's size are permuted again until they fall inside
(cycle walking), which leaves a permutation of the row numbers. So the k-th draw of a source is
document ``permuted(k mod size)`` of epoch ``k div size``, by arithmetic alone, and a run goes on at any
draw from a number for each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators import mixing
from corpuskit.plans.durable import numbered

ROUNDS = 6
# An odd multiplier near 2**32 over the golden ratio, and the two of a well-known 32-bit finaliser.
GOLDEN, MIX1, MIX2 = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
LOW = np.uint64(0xFFFFFFFF)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, each bit of which depends on all bits of the number given."""
    x = (x ^ x >> np.uint64(16)) * np.uint64(MIX1) & LOW
    x = (x ^ x >> np.uint64(13)) * np.uint64(MIX2) & LOW
    return x ^ x >> np.uint64(16)


def _network(x: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of the numbers of ``left + right`` bits; halves may differ in size, as they take turns."""
    one = np.uint64(1)
    a, b = x >> right, x & (one << right) - one
    for i in range(ROUNDS):
        own = key + np.uint64(i * GOLDEN) & LOW
        if i % 2:
            b = b ^ _scrambled(a ^ own) & (one << right) - one
        else:
            a = a ^ _scrambled(b ^ own) & (one << left) - one
    return a << right | b


def permutation(pos: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each place from 0 to below its size goes; a key is a 32-bit number, a size below 2**62."""
    # Bits of the largest place, exactly: logarithms of large numbers round.
    bits = np.array([max(1, int(n - 1).bit_length()) for n in size.tolist()], np.uint64) if len(size) else size.astype(np.uint64)
    left, size, key, x = bits // np.uint64(2), size.astype(np.uint64), key.astype(np.uint64), pos.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _network(x[todo], left[todo], (bits - left)[todo], key[todo])
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def key_of(*parts: Column) -> Column:
    """A 32-bit key from the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def permuted(pos: Column, size: Column, key: Column) -> Column:
    """The place of ``pos`` in the keyed permutation of 0 to below ``size``."""

    @F.pandas_udf("bigint")
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for at, n, k in batches:
            yield pd.Series(permutation(at.to_numpy(), n.to_numpy(), k.to_numpy()))

    return place(pos.cast("long"), size.cast("long"), key)


def cursors_at(spark: SparkSession, first: int, stage_weights: DataFrame, seed: int = mixing.SEED, per_step: int = 1) -> DataFrame:
    """``(source, k)``: how many of the draws before ``first`` each source has; all that a resumed run needs."""
    return mixing.draws(spark, first, stage_weights, seed, per_step).groupBy("source").agg(F.count(F.lit(1)).alias("k"))


def sample(docs: DataFrame, n: int, stage_weights: DataFrame, seed: int = mixing.SEED, per_step: int = 1, first: int = 0, cursors: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(i, step, source, epoch, doc_id)`` of draws ``first`` to below ``n``, with replacement across epochs only.

    ``cursors(source, k)`` are those of ``cursors_at(first)``, counted anew if not given. Draws of a
    source without documents are left out, as are documents without a source. Repeated ids are documents of their own.
    """
    spark = docs.sparkSession
    if first and cursors is None:
        cursors = cursors_at(spark, first, stage_weights, seed, per_step)
    rows = numbered(docs.where(F.col(source_col).isNotNull()).select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("__at")), ["doc_id", "__at"], "row", ["source"]).drop("__at")
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("size"))
    drawn = numbered(mixing.draws(spark, n, stage_weights, seed, per_step).where(F.col("i") >= first), ["i"], "k", ["source"])
    if first:
        drawn = drawn.join(cursors.withColumnRenamed("k", "begun"), "source", "left").withColumn("k", F.col("k") + F.coalesce("begun", F.lit(0))).drop("begun")
    drawn = drawn.join(sizes, "source").withColumn("epoch", F.floor(F.col("k") / F.col("size")))
    place = permuted(F.col("k") % F.col("size"), F.col("size"), key_of(F.lit(seed), F.col("source"), F.col("epoch")))
    drawn = drawn.select("i", "step", "source", "epoch", place.alias("row"))
    return drawn.join(rows, ["source", "row"]).select("i", "step", "source", "epoch", "doc_id")
