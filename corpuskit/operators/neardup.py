"""MinHash-LSH near-duplicates with first-occurrence-wins semantics.

A document goes if it shares a band with an earlier document that stays. That is the
lexicographically first maximal independent set of the collision graph; it is found in rounds: an
undecided document without an undecided smaller neighbour stays, and its neighbours go.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.lots import lots
from corpuskit.plans.durable import BROADCAST, cut

PRIME = (1 << 31) - 1
BASE = 1_000_003
SHINGLE = 5
PERMUTATIONS = 128
#: Shingles that are permuted together, few enough for a processor's cache.
LOT = 512
#: Rounds over all undecided nodes before prefixes are decided, and the nodes of a prefix.
ROUNDS = 12
PREFIX = 200_000
#: Characters and nodes of a chunk of a bucket, about; the pairs of two chunks are compared at once.
CHUNK_CHARS = 1 << 21
CHUNK_NODES = 1024
#: Shingles of a unit that are columns of one matrix, and pairs that are given out together.
COLUMNS = 2048
OUT = 1 << 16
#: Ids that are broadcast at most to choose texts.
IDS = 1_000_000


def permutation_constants(n: int = PERMUTATIONS) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of the hash family (a linear generator modulo the prime)."""
    x, out = 20_240_229, []
    for _ in range(2 * n):
        x = x * 48_271 % PRIME
        out.append(x)
    return out[:n], out[n:]


def bands_for(threshold: float = 0.8, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """Bands and rows that minimise the summed areas of false positives and negatives of the S-curve."""
    grid = np.linspace(0, 1, 1001)
    best = (float("inf"), 1, permutations)
    for bands in range(1, permutations + 1):
        for rows in range(1, permutations // bands + 1):
            hit = 1 - (1 - grid**rows) ** bands
            low, high = grid <= threshold, grid >= threshold
            error = np.trapezoid(hit[low], grid[low]) + np.trapezoid(1 - hit[high], grid[high])
            if error < best[0] - 1e-12:
                best = (error, bands, rows)
    return best[1], best[2]


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the character n-grams; the whole text is the only one if it is shorter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = min(n, len(codes))
    h = np.zeros(len(codes) - size + 1, np.int64)
    for i in range(size):
        h = _modulo(h * BASE + codes[i : i + len(h)])
    return np.unique(h)


def _modulo(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 to below 2**62 modulo the prime, in place; it is 2**31 - 1, so halves are added in place of a division."""
    for _ in range(2):
        high = x >> 31
        x &= PRIME
        x += high
    x -= PRIME * (x >= PRIME)
    return x


@lru_cache(8)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = permutation_constants(n)
    return np.array(a, np.int64)[:, None], np.array(b, np.int64)[:, None]


def minhash(text: str, n: int = SHINGLE, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Signature: the least permuted hash for each permutation."""
    a, b = _family(permutations)
    hashes, out = shingle_hashes(text, n), np.full(permutations, PRIME, np.int64)
    for i in range(0, len(hashes), LOT):
        # As ``_modulo``, the second half in 32 bits: what is below the prime wraps when it is taken off.
        x = a * hashes[None, i : i + LOT]
        x += b
        y = x >> 31
        x &= PRIME
        x += y
        y = x.astype(np.uint32)
        z = y >> 31
        y &= PRIME
        y += z
        np.subtract(y, PRIME, out=z)
        np.minimum(y, z, out=y)
        out = np.minimum(out, y.min(axis=1))
    return out


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct character n-grams as an array (for short texts; quadratic in the length)."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(every)


def signatures(docs: DataFrame, keys: list[str], text_col: str = "text", n: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """``keys`` and ``signature`` of the rows with text; rows without text are neither kept nor duplicates."""

    @F.pandas_udf("array<bigint>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in lots(batches):
            yield pd.Series([minhash(x, n, permutations) for x in texts])

    return docs.where(F.length(text_col) > 0).select(*keys, sign(text_col).alias("signature"))


def _sets(batches: Iterator[pd.Series], n: int = SHINGLE) -> Iterator[pd.Series]:
    for texts in lots(batches):
        yield pd.Series([shingle_hashes(x, n) for x in texts])


def shingle_sets(docs: DataFrame, keys: list[str], text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """``keys`` and ``shingles``, the distinct shingle hashes, of the rows with text."""

    @F.pandas_udf("array<bigint>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _sets(batches, n)

    return docs.where(F.length(text_col) > 0).select(*keys, hashes(text_col).alias("shingles"))


def memberships(signed: DataFrame, order: str = "doc_id", scope: list[str] | None = None, threshold: float = 0.8, permutations: int = PERMUTATIONS) -> tuple[DataFrame, DataFrame]:
    """``(nodes, members)``: the first row of each signature, and the band buckets of each as ``(n, k1, k2)``.

    Rows with equal signatures are decided alike, so only the first of them is a node. Two hashes
    name a bucket: its scope (null is one of its own), band and values.
    """
    scope = scope or []
    bands, rows = bands_for(threshold, permutations)
    nodes = cut(signed.groupBy(*scope, "signature").agg(F.min(order).alias(order)))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.slice("signature", i * rows + 1, F.lit(rows)).alias("key")))
    banded = nodes.select(*scope, order, F.inline(keys))
    names = [F.xxhash64(F.lit(seed), *scope, "band", "key").alias(f"k{seed}") for seed in (1, 2)]
    return nodes, banded.select(F.col(order).alias("n"), *names)


def collisions(signed: DataFrame, order: str = "doc_id", scope: list[str] | None = None, threshold: float = 0.8, permutations: int = PERMUTATIONS) -> DataFrame:
    """``(a, b)``: pairs of nodes that share a band, a report whose size is the number of pairs."""
    members = memberships(signed, order, scope, threshold, permutations)[1]
    left, right = members.withColumnRenamed("n", "a"), members.withColumnRenamed("n", "b")
    return left.join(right, ["k1", "k2"]).where("a < b").select("a", "b").distinct()


def _meetings(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of items that each set of ``left`` has in common with each of ``right``, by products of 0/1 matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # An item of one set alone meets nothing, and gets no column.
    often = counts > 1
    shared, width = often[column], int(often.sum())
    owner, column = owner[shared], (np.cumsum(often) - 1)[column[shared]]
    by = np.argsort(column)
    owner, column = owner[by], column[by]
    out = np.zeros((len(left), len(right)))
    for low in range(0, width, COLUMNS):
        start, end = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, width - low)), np.float32)
        has[owner[start:end], column[start:end] - low] = 1
        out += has[left] @ has[right].T
    return out


def _unit(rows: pa.Table, n: int) -> pa.RecordBatch:
    """``(a, b, jaccard)`` of a unit's pairs, but for those that share a bucket before this one, where they are found."""
    g, i, j = (rows.column(c)[0].as_py() for c in ("g1", "i", "j"))
    ids, own = rows.column("n").to_numpy(), rows.column("own").to_numpy()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    a, b = ids[left][:, None], ids[right][None, :]
    open_ = a < b if i == j else a != b
    buckets = rows.column("buckets").combine_chunks()
    row, bucket = np.repeat(np.arange(len(ids)), buckets.value_lengths().to_numpy()), buckets.flatten().to_numpy()
    row, bucket = row[bucket < g], bucket[bucket < g]
    by = np.argsort(bucket, kind="stable")
    for same in np.split(row[by], np.flatnonzero(np.diff(bucket[by])) + 1):
        open_[np.ix_(np.isin(left, same), np.isin(right, same))] = False
    x, y = np.nonzero(open_)
    if len(x):
        sets = [shingle_hashes(t, n).astype(np.int32) for t in rows.column("text").to_pylist()]
        sizes, k = np.array([len(s) for s in sets]), _meetings(sets, left, right)[x, y]
        x, y, k = x[k > 0], y[k > 0], k[k > 0]
        score = k / (sizes[left[x]] + sizes[right[y]] - k)
    else:
        score = np.zeros(0)
    x, y = ids[left[x]], ids[right[y]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score)], ["a", "b", "jaccard"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit, which follow one another."""
    last, held = None, []
    for batch in filter(len, batches):
        keys = np.stack([batch.column(c).to_numpy() for c in ("g1", "g2", "i", "j")], axis=1)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for low, high in zip([0, *ends], ends):
            if held and tuple(keys[low]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[low])
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def similarities(docs: DataFrame, members: DataFrame, order: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """``(a, b, jaccard)``: the pairs of ``collisions`` with the exact similarity of their shingle sets.

    Texts go to buckets and never to pairs. Buckets with the same nodes are one; a large one is cut into
    chunks, and a unit of work is two of its chunks (or one with itself), so a text goes once to each
    chunk of each of its buckets. A unit compares all of its pairs, each of them in the first bucket that
    it shares. What is shuffled grows with the texts and their chunks; the pairs are only given out.
    """
    members = members.where("n IS NOT NULL")
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "n")).alias(f"g{seed}") for seed in (1, 2)]
    buckets = members.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("size"), *marks).where("size > 1")
    met = cut(members.join(buckets, ["k1", "k2"]).groupBy("n").agg(F.collect_set(F.struct("g1", "g2")).alias("buckets")))
    ids = F.broadcast(met.select("n")) if met.count() <= IDS else met.select("n")
    texts = docs.where(F.length(text_col) > 0).select(F.col(order).alias("n"), F.col(text_col).alias("text")).join(ids, "n", "left_semi")
    sizes = texts.select("n", F.length("text").alias("chars")).join(met, "n").select("chars", F.inline("buckets"))
    chunks = F.greatest(F.ceil(F.sum("chars") / CHUNK_CHARS), F.ceil(F.count(F.lit(1)) / CHUNK_NODES)).alias("chunks")
    large = cut(sizes.groupBy("g1", "g2").agg(chunks).where("chunks > 1"))
    rows = texts.join(met, "n").select("n", "text", F.col("buckets.g1").alias("buckets"), F.inline("buckets"))
    rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST else large, ["g1", "g2"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("n"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = ["g1", "g2", "i", "j"]
    rows = rows.select("g1", "g2", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", "buckets", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in (_unit(x, n) for x in _units(batches)):
            held, size = [*held, found], size + len(found)
            if size >= OUT or len(held) >= OUT // 64:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(compare, "a long, b long, jaccard double")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which nodes stay among those that come, in order, with their buckets; a node's rows follow one another."""
    taken: set[tuple[int, int]] = set()
    last, own, out = None, [], []

    def decide() -> None:
        stays = not any(k in taken for k in own)
        if stays:
            taken.update(own)
        out.append((last, stays))

    for batch in batches:
        for n, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("n", "k1", "k2"))):
            if n != last and own:
                decide()
                own = []
            last = n
            own.append((k1, k2))
    if own:
        decide()
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_())], ["n", "stays"])


def _local_round(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that stay as the smallest of all of their buckets, and those that share a bucket with one."""
    stay = seen.groupBy("n").agg(F.max(F.col("low") < F.col("n")).alias("waits")).where("NOT waits").select(F.col("n").alias("low"))
    return stay, cut(seen.where("low < n").join(stay, "low", "left_semi").select("n").distinct())


def _prefix_round(seen: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The same of the ``size`` smallest nodes, of which one task decides all: none depends on a larger one."""
    end = seen.select("n").distinct().orderBy("n").limit(size).agg(F.max("n")).first()[0]
    rows = seen.where(F.col("n") <= end).select("n", "k1", "k2").repartition(1).sortWithinPartitions("n")
    stay = cut(rows.mapInArrow(_greedy, "n long, stays boolean")).where("stays").select(F.col("n").alias("low"))
    buckets = seen.join(stay, F.col("n") == stay["low"], "left_semi").select("k1", "k2").distinct()
    lost = seen.drop("low").join(buckets, ["k1", "k2"], "left_semi").select("n").distinct()
    return stay, cut(lost.join(stay, F.col("n") == F.col("low"), "left_anti"))


def first_wins(nodes: DataFrame, members: DataFrame, order: str = "doc_id") -> DataFrame:
    """Ids of the nodes that stay.

    In each round the smallest undecided node of all of its buckets stays, and all others of these
    buckets go. A round aggregates the memberships and never pairs the nodes of a bucket, so a
    bucket that holds a large share of the nodes costs its size and not the square of it. Chains, in
    which each node waits for the one before, would take a round a link; after ``ROUNDS`` rounds the
    ``PREFIX`` smallest undecided nodes, a bounded number, are decided at once. Nodes are whole numbers.
    """
    gone, open_ = None, cut(members)
    for number in itertools.count():
        lows = open_.groupBy("k1", "k2").agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low < high").drop("high")
        seen = cut(open_.join(lows, ["k1", "k2"]))
        if seen.isEmpty():
            break
        stay, lost = _local_round(seen) if number < ROUNDS else _prefix_round(seen, PREFIX)
        gone = lost if gone is None else gone.unionByName(lost)
        open_ = seen.drop("low").join(lost, "n", "left_anti")
        if number >= ROUNDS:
            open_ = open_.join(stay, F.col("n") == F.col("low"), "left_anti")
    if gone is None:
        return nodes.select(order)
    return nodes.join(gone.withColumnRenamed("n", "__gone"), F.col(order) == F.col("__gone"), "left_anti").select(order)


def near_duplicates(docs: DataFrame, order: str = "doc_id", scope: str | None = "source", text_col: str = "text", threshold: float = 0.8, permutations: int = PERMUTATIONS, n: int = SHINGLE) -> DataFrame:
    """Rows that stay, in all columns. ``scope=None`` removes across files, else within each file."""
    keys = [order] + ([scope] if scope else [])
    signed = cut(signatures(docs, keys, text_col, n, permutations))
    kept = first_wins(*memberships(signed, order, [scope] if scope else [], threshold, permutations), order)
    return docs.join(kept, order, "left_semi")


def dedup_stats(docs: DataFrame, kept: DataFrame, by: str = "source", text_col: str = "text") -> DataFrame:
    """Per file: total, duplicates, remaining, dedup_rate; rows without text count in total alone."""
    total = docs.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.length(text_col) > 0).alias("with_text"))
    left = kept.groupBy(by).agg(F.count(F.lit(1)).alias("remaining"))
    stats = total.join(left, by, "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
    return stats.select(by, "total", (F.col("with_text") - F.col("remaining")).alias("duplicates"), "remaining").withColumn("dedup_rate", F.try_divide("duplicates", "total"))


def exact_duplicates(docs: DataFrame, order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id)`` of the first row of each distinct text."""
    return docs.groupBy(F.xxhash64(text_col), F.md5(text_col)).agg(F.min(order).alias(order)).select(order)
