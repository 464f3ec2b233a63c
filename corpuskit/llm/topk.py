"""Exact top-k inner-product search by distributed histogram selection.

Every query is scored against every candidate, in blocks. A pass counts the scores of each query
in equal bins over the range still open; the bin in which the k-th highest score lies is the range
of the next pass, until the bin holds a single value or exactly the scores still wanted. The last
pass keeps the scores at or above each query's threshold and breaks ties by the smaller id.
Nothing is sampled and no score is stored between passes.

Queries are handled in blocks of at most about ``BLOCK`` (a hash of the id deals them); a block's
vectors and its histograms, ``BLOCK * BINS`` counts, are all that the driver or a task ever holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.plans.durable import cut

K = 5
BLOCK = 8192
BINS = 64
SCALE = 256.0
ROWS = 512
EXACT = 2.0**53
#: Scores are long integers; what is beyond them counts as the largest or the smallest.
LONG = (-(2**63), 2**63 - 1)
#: Scores are counted as unsigned numbers in the same order.
SIGN = np.uint64(1 << 63)


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows of this length."""
    vec = batch.column(1)
    sizes = np.diff(vec.offsets.to_numpy())
    at = pa.array(np.nonzero(sizes == dim)[0])
    flat = vec.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column(0).take(at).to_numpy(zero_copy_only=False), flat.reshape(-1, dim)


def _whole(x: float) -> int:
    """Floor of 256 x as an integer of any size; a double of 2**53 or more is whole by itself."""
    return math.floor(x * SCALE) if abs(x) < EXACT else int(x) * int(SCALE)


def quantised(vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Floor of 256 x: in doubles where scores fit them, else as Python's integers."""
    if exact:
        return np.floor(SCALE * vectors)
    return np.array([_whole(x) for x in vectors.ravel().tolist()], object).reshape(vectors.shape)


def scores_of(vectors: np.ndarray, queries: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of quantised vectors; doubles hold them exactly below 2**53."""
    found = vectors @ queries.T
    return (found if exact else np.clip(found, *LONG)).astype(np.int64)


def _unsigned(scores: np.ndarray) -> np.ndarray:
    return scores.view(np.uint64) ^ SIGN


def _signed(numbers: np.ndarray) -> np.ndarray:
    return (numbers ^ SIGN).view(np.int64)


def _usable(vec: Column) -> Column:
    fine = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def _block_top(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, largest: float, k: int) -> DataFrame:
    """Top k of one block of queries of one length: ``(q, rank, vec_id, score)``."""
    spark, dim, n = rows.sparkSession, queries.shape[1], len(ids)
    with np.errstate(over="ignore", invalid="ignore"):
        reach = (np.sqrt(((np.abs(SCALE * queries) + 1) ** 2).sum(axis=1)) * largest).max()
    exact = bool(reach < EXACT)
    bound = min(LONG[1], math.ceil(reach) + 2) if np.isfinite(reach) else LONG[1]
    least, most = (1 << 63) - bound - 1, (1 << 63) + bound
    # The open range of each query, both ends in it; scores above it are counted already.
    low, high = np.full(n, least, np.uint64), np.full(n, most, np.uint64)
    width = np.full(n, -(-(most - least + 1) // BINS), np.uint64)
    want, done = np.full(n, k, np.int64), np.zeros(n, bool)
    shared = spark.sparkContext.broadcast((ids, queries))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        own, asked = shared.value
        asked = quantised(asked, exact)
        for batch in batches:
            vec_ids, vectors = _vectors(batch, dim)
            for i in range(0, len(vec_ids), ROWS):
                part = vec_ids[i : i + ROWS]
                yield part, _unsigned(scores_of(quantised(vectors[i : i + ROWS], exact), asked, exact)), part[:, None] != own[None, :]

    def histogram(low: np.ndarray, high: np.ndarray, width: np.ndarray, open_: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(open_) * BINS, np.int64)
            for _, scores, other in blocks(batches):
                scores = scores[:, open_]
                row, q = np.nonzero((scores >= low[open_]) & (scores <= high[open_]) & other[:, open_])
                bins = (scores[row, q] - low[open_][q]) // width[open_][q]
                counts += np.bincount(bins.astype(np.int64) + q * BINS, minlength=len(counts))
            some = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["slot", "n"])

        return run

    while not done.all():
        open_ = np.nonzero(~done)[0]
        found = rows.mapInArrow(histogram(low, high, width, open_), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(open_) * BINS, np.int64)
        counts[found["slot"].to_numpy()] = found["n"].to_numpy()
        above = np.cumsum(counts.reshape(-1, BINS)[:, ::-1], axis=1)  # scores in a bin or above it
        for i, q in enumerate(open_):
            if above[i, -1] <= want[q]:  # all that there are
                done[q] = True
                continue
            j = int(np.argmax(above[i] >= want[q]))
            begin, step = int(low[q]) + (BINS - 1 - j) * int(width[q]), int(width[q])
            low[q], high[q] = begin, min(int(high[q]), begin + step - 1)
            want[q] -= above[i, j - 1] if j else 0
            done[q] = step == 1 or above[i, j] - (above[i, j - 1] if j else 0) == want[q]
            width[q] = -(-step // BINS)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for vec_ids, scores, other in blocks(batches):
            row, q = np.nonzero((scores >= low) & other)
            q, s, v = (np.concatenate(x) for x in zip(kept, (q, scores[row, q], vec_ids[row])))
            order = np.lexsort((v, ~s, q))
            q, s, v = q[order], s[order], v[order]
            start = np.concatenate(([0], np.nonzero(q[1:] != q[:-1])[0] + 1))
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate((start, [len(q)])))) if len(q) else q
            kept = [q[place < k], s[place < k], v[place < k]]
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(_signed(kept[1])), pa.array(kept[2])], ["q", "score", "vec_id"])

    best = rows.mapInArrow(pick, "q long, score long, vec_id long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q2 long, query_id long")
    return best.join(names, F.col("q") == F.col("q2")).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best rows, all if there are fewer.

    Queries are the rows for which ``is_query`` holds; a row is no candidate of a query with its id.
    Rows with a null id, or whose vector is null, empty or holds a null or non-finite component,
    take no part; vectors of different lengths have no score. A repeated query id is asked once per
    row. Ties go to the smaller id. Without queries there are no rows. Scores are exact, of
    components of any size; those that no long integer holds are its largest or smallest value, and tie.
    """
    vec = F.col(vec_col)
    rows = vectors.where(_usable(vec) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), is_query.alias("asked"))
    # An upper bound of the quantised length, infinite where doubles do not hold it.
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double") * SCALE) + 1, F.lit(2.0)))
    facts = rows.groupBy(F.size("vec").alias("dim")).agg(F.max(F.sqrt(squares)).alias("largest"), F.sum(F.col("asked").cast("int")).alias("n")).collect()
    out = None
    for fact in sorted((f for f in facts if f.n), key=lambda f: f.dim):
        count = math.ceil(fact.n / BLOCK)
        asked = rows.where(F.col("asked") & (F.size("vec") == fact.dim))
        for i in range(count):
            block = asked.where(F.expr(f"pmod(xxhash64(vec_id), {count}L) = {i}")).select("vec_id", "vec").toArrow()
            for batch in block.combine_chunks().to_batches():
                ids, queries = _vectors(batch, fact.dim)
                found = cut(_block_top(rows.select("vec_id", "vec"), ids, queries, fact.largest, k))
                out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out
