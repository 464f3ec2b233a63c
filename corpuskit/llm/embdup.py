"""Embedding near-duplicates by random-hyperplane sign hashing, exact cosine and connected components.

A table gives a vector the signs of its products with a few random hyperplanes as key; vectors
that agree in the key of at least one of several tables are candidates. The number of hyperplanes
follows the logarithm of the number of vectors, so that a bucket of unrelated vectors keeps its
size; the number of tables follows from the recall asked for at the threshold itself (closer pairs
are found more surely).

Only the signs of a vector, one bit each, travel to its buckets. Pairs whose signs differ in more
places than a pair at the threshold ever would (``SPREAD`` standard deviations above its mean) are
no candidates. Vectors with a candidate are then brought together, again by bucket, and compared
exactly in double precision. A pair belongs to the first table that has it alone, so links are
counted without a shuffle of pairs. Buckets of more than ``CHUNK`` vectors are dealt in pairs of
chunks, so no task gets a whole hot bucket and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import components
from corpuskit.plans.durable import cut

MIN_COS = 0.9
RECALL = 0.999
BUCKET = 32
CHUNK = 2048
ROWS = 256
SEED = 7
#: Signs that a vector has at least, so that few of them tell pairs apart in small tables too.
SIGNS = 256
SPREAD = 6.0
GROUP = ("dim", "t", "bucket", "ca", "cb")


def tables_for(n: int, min_cos: float = MIN_COS, recall: float = RECALL) -> tuple[int, int]:
    """Hyperplanes per table and number of tables for ``n`` vectors; a key has at most 62 bits."""
    same = 1 - math.acos(min_cos) / math.pi
    bits = min(62, max(4, math.ceil(math.log2(max(n, 2) / BUCKET))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def most_differing(signs: int, min_cos: float = MIN_COS) -> int:
    """Signs in which a pair at the threshold may differ: a binomial's mean and ``SPREAD`` deviations."""
    other = math.acos(min_cos) / math.pi
    return math.ceil(signs * other + SPREAD * math.sqrt(signs * other * (1 - other)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    big = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / big
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _signs(vectors: np.ndarray, signs: int) -> np.ndarray:
    """Signs of the products with the hyperplanes, as rows of 0 and 1."""
    planes = np.random.Generator(np.random.PCG64([SEED, vectors.shape[1]])).standard_normal((vectors.shape[1], signs))
    return (vectors @ planes > 0).astype(np.uint8)


def _keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Key of each table from rows of signs."""
    return signs[:, : bits * tables].reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    """List arrays of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _hashed(bits: int, tables: int):
    signs = max(SIGNS, bits * tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vec").offsets.to_numpy())
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.nonzero(sizes == size)[0]))
                found = _signs(_unit(_matrix(rows.column("vec"))), signs)
                keys = pa.ListArray.from_arrays(np.arange(0, len(found) * tables + 1, tables, dtype=np.int32), _keys(found, bits, tables).ravel())
                packed = pa.array([x.tobytes() for x in np.packbits(found, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(np.full(len(rows), size), pa.int32()), packed, keys], ["node", "dim", "signs", "keys"])

    return run


def _unpacked(group: pa.Table) -> np.ndarray:
    """Bytes of the signs of a group's rows."""
    return np.frombuffer(b"".join(group.column("signs").to_pylist()), np.uint8).reshape(group.num_rows, -1)


class _Pairs:
    """Which pairs of a group's rows are its own: across its two chunks, if it has two, and of no earlier table."""

    def __init__(self, group: pa.Table, bits: int, tables: int):
        first = {k: group.column(k)[0].as_py() for k in GROUP}
        self.signs = _unpacked(group)
        self.t = first["t"]
        self.keys = _keys(np.unpackbits(self.signs, axis=1)[:, : bits * tables], bits, tables)[:, : self.t]
        self.cross = first["ca"] != first["cb"]
        self.side = group.column("chunk").to_numpy() == first["ca"]

    def across(self, low: int, high: int) -> np.ndarray:
        """A matrix of the rows from ``low`` to ``high`` by all rows: pairs of different rows that this group compares."""
        own = self.side[low:high, None] != self.side[None, :] if self.cross else np.ones((high - low, len(self.side)), bool)
        own[np.arange(high - low), np.arange(low, high)] = False
        return own

    def first(self, own: np.ndarray, low: int, high: int) -> np.ndarray:
        """The pairs of ``own`` that agree in the key of no earlier table."""
        own = own.copy()
        for k in range(self.t):
            own &= self.keys[low:high, k][:, None] != self.keys[:, k][None, :]
        return own


def _candidates(group: pa.Table, bits: int, tables: int, differing: int) -> pa.RecordBatch | None:
    """The rows of a group that have a candidate there."""
    pairs = _Pairs(group, bits, tables)
    wide = np.zeros((group.num_rows, -(-pairs.signs.shape[1] // 8) * 8), np.uint8)
    wide[:, : pairs.signs.shape[1]] = pairs.signs
    words, found = wide.view(np.uint64), np.zeros(group.num_rows, bool)
    for low in range(0, group.num_rows, ROWS):
        high = min(low + ROWS, group.num_rows)
        apart = np.zeros((high - low, group.num_rows), np.uint16)
        for k in range(words.shape[1]):
            apart += np.bitwise_count(words[low:high, k][:, None] ^ words[None, :, k])
        near = pairs.across(low, high) & (apart <= differing)
        if near.any():
            found[low:high] |= pairs.first(near, low, high).any(axis=1)
    if not found.any():
        return None
    kept = group.filter(pa.array(found)).combine_chunks()
    return pa.RecordBatch.from_arrays([kept.column(k).combine_chunks() for k in (*GROUP, "chunk", "node")], [*GROUP, "chunk", "hit"])


def _forest(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each row of a link matrix the smallest node it reaches."""
    label = nodes.copy()
    while True:
        low = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, low)
        if (new == label).all():
            return label
        label = new


def _compare(group: pa.Table, bits: int, tables: int, min_cos: float) -> pa.RecordBatch | None:
    """Links in one bucket, or between two chunks of one: per vector the links first found here and the least node reached."""
    pairs, nodes, m = _Pairs(group, bits, tables), group.column("node").to_numpy(), group.column("m").to_numpy()
    unit = _unit(_matrix(group.column("vec").combine_chunks()))
    linked, n = np.zeros((len(nodes), len(nodes)), bool), np.zeros(len(nodes), np.int64)
    for low in range(0, len(nodes), ROWS):
        high = min(low + ROWS, len(nodes))
        linked[low:high] = pairs.across(low, high) & (unit[low:high] @ unit.T >= min_cos)
        if linked[low:high].any():
            n[low:high] = pairs.first(linked[low:high], low, high) @ m
    at = np.nonzero(linked.any(axis=1))[0]
    if not len(at):
        return None
    root = _forest(linked[np.ix_(at, at)], nodes[at])
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (nodes[at], n[at], root)], ["node", "n", "root"])


def _grouped(work: Callable[[pa.Table], pa.RecordBatch | None]):
    """Runs ``work`` on each group of rows that come sorted by ``GROUP``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(rows: pa.Table, last: bool):
            # The last group of a batch may go on in the next one.
            marks = np.stack([rows.column(k).to_numpy() for k in GROUP])
            starts = np.concatenate(([0], np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1))
            ends = np.concatenate((starts[1:], [rows.num_rows]))
            for a, b in zip(starts[: None if last else -1], ends):
                if b - a > 1 and (found := work(rows.slice(a, b - a))):
                    yield found
            if not last:
                yield rows.slice(starts[-1])

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = pa.concat_tables([rest, rows]) if rest is not None else rows
                for found in groups(rows, False):
                    if isinstance(found, pa.Table):
                        rest = found
                    else:
                        yield found
        if rest is not None:
            yield from groups(rest, True)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cos: float = MIN_COS, recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing and
    name their own component. Vectors of different lengths never link. Rows that repeat a vector
    link with each other; they are compared once with their number as weight. A vector without an
    id links like any other, but names no component: its component's id is null only if all ids in
    it are, and rows of such a component are all ``kept``. An empty input gives no rows. Ties do not
    arise: the smallest id reachable names a component.
    """
    vec = F.col(vec_col)
    fine = F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), fine.alias("fine"))
    rows = rows.withColumn("h1", F.when(F.col("fine"), F.xxhash64("vec"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(1), "vec")))
    good = rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec"))
    # Numbers of distinct vectors: the cut table's partitions are fixed, so they stay the same.
    good = cut(good).withColumn("node", F.monotonically_increasing_id())
    n = good.count()
    bits, tables = tables_for(n, min_cos, recall)
    differing = most_differing(max(SIGNS, bits * tables), min_cos)
    parts = max(1, min(n // 256, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hashed = cut(good.select("node", "vec").repartition(parts).mapInArrow(_hashed(bits, tables), "node long, dim int, signs binary, keys array<long>"))

    each = hashed.select("node", "dim", "signs", F.posexplode("keys").alias("t", "bucket"))
    heavy = cut(hashed.select("dim", F.posexplode("keys").alias("t", "bucket")).groupBy("dim", "t", "bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CHUNK))
    if heavy.isEmpty():
        each = each.withColumn("ca", F.lit(0)).withColumn("cb", F.lit(0)).withColumn("chunk", F.lit(0))
    else:
        chunks = heavy.select("dim", "t", "bucket", F.ceil(F.col("rows") / (CHUNK / 2)).cast("int").alias("chunks"))
        each = each.join(chunks, ["dim", "t", "bucket"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        each = each.withColumn("chunk", F.expr("int(pmod(xxhash64(node), chunks))")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        each = each.withColumn("ca", F.least("chunk", "other")).withColumn("cb", F.greatest("chunk", "other")).drop("chunks", "other")
    kind = "dim int, t int, bucket long, ca int, cb int, chunk int, hit long"
    hits = cut(_dealt(each).mapInArrow(_grouped(lambda g: _candidates(g, bits, tables, differing)), kind))
    near = hits.join(good.select("node", "m", "vec"), F.col("hit") == F.col("node")).join(hashed.select(F.col("node").alias("node2"), "signs"), F.col("hit") == F.col("node2"))
    found = cut(_dealt(near.drop("hit", "node2")).mapInArrow(_grouped(lambda g: _compare(g, bits, tables, min_cos)), "node long, n long, root long"))

    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "node2")
    named = good.select("h1", "h2", "node", "low", "m").join(counts, "node", "left").join(joined, F.col("node") == F.col("node2"), "left")
    named = cut(named.selectExpr("h1 AS g1", "h2 AS g2", "low", "coalesce(n, 0) + m - 1 AS n_links", "component"))
    lows = named.where("component IS NOT NULL").groupBy("component").agg(F.min("low").alias("component_low")).withColumnRenamed("component", "component2")
    named = named.join(lows, F.col("component") == F.col("component2"), "left").selectExpr("g1", "g2", "n_links", "if(component IS NULL, low, component_low) AS component_id")
    out = rows.drop("vec").join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
