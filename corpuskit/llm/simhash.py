"""SimHash near-duplicate detection through a segment-popcount embedding.

A 64-bit fingerprint is cut into segments; the vector of the segments' bit counts embeds it so that
the Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints. If two
fingerprints differ in at most three bits, one of the two halves of their vectors has Manhattan
distance at most one. Each half is therefore a grid cell, joined with itself and the cells one step
away along one axis; every pair found is verified exactly by Hamming distance. Cells at distance one
differ in the parity of their sum, so only the rows of even cells look around.

Segments have two bits, up to ``WIDE_MAX`` fingerprints: of n of them about 7e-6 n**2 / 2 pairs are
verified. Beyond that they have one bit, which gives 450 times fewer candidates for a third more
neighbours. Equal fingerprints collapse to one node first, so copies form no pairs. A cell with more than
``HOME`` fingerprints of its own, as a large group of near copies makes, is dealt in chunks and gives
the edges of a spanning forest in place of its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import components, plain_names, spread_join
from corpuskit.plans.durable import cut

MAX_BITS = 3
SHINGLE = 3
CHUNK = 200_000
#: Fingerprints up to which segments have two bits.
WIDE_MAX = 10_000_000
#: Fingerprints of its own that a cell may have if its pairs are joined; more are dealt in chunks of ``HOME_CHUNK``.
HOME, HOME_CHUNK = 128, 2048
#: Rows of 24 bytes or less that are broadcast at most.
BROADCAST = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text as an unsigned integer; 0 for null or wordless text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size) + np.arange(len(size))
    first, last = (ends - size)[: 1 - shingle or None], ends[shingle - 1 :]
    if len(words) < shingle:
        first, last = np.zeros(1, np.int64), ends[-1:]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), CHUNK):
        pairs = zip(first[i : i + CHUNK].tolist(), last[i : i + CHUNK].tolist())
        hashes = np.array([hash64(norm[a:b], 42) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(x.as_py()) for x in batch.column(2)]
        signed = np.array(prints, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed, pa.int64())], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp)`` for every row; ``fp`` holds the 64 bits as a signed long, ``text_key`` is a hash of the text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_key long, fp long")


def _cells(nodes: DataFrame, width: int) -> tuple[DataFrame, str]:
    """Each fingerprint with the grid cell of either half, and the SQL array of the cells one step away.

    At ``width`` 2 a cell is 16 counts of 0 to 2, two bits each; at 1 it is 32 counts of 0 or 1.
    """
    half = "stack(2, 0, fp & 4294967295L, 1, shiftrightunsigned(fp, 32)) AS (half, bits)"
    rows = nodes.selectExpr("fp", half)
    if width == 1:
        return rows.selectExpr("fp", "half", "bits AS cell", "bit_count(bits) % 2 = 1 AS odd"), "transform(sequence(0, 31), i -> cell ^ shiftleft(1L, i))"
    cells = rows.selectExpr("fp", "half", "bits - (shiftrightunsigned(bits, 1) & 1431655765L) AS cell")
    # One count up where it is below 2, one down where it is above 0.
    steps = """flatten(transform(sequence(0, 15), i -> filter(array(
        if((shiftright(cell, 2 * i) & 3) < 2, cell + shiftleft(1L, 2 * i), NULL),
        if((shiftright(cell, 2 * i) & 3) > 0, cell - shiftleft(1L, 2 * i), NULL)), c -> c IS NOT NULL)))"""
    return cells.withColumn("odd", F.expr("(bit_count(cell & 1431655765L)) % 2 = 1")), steps


def _forest(home: np.ndarray, every: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(a, b)`` that connect what the links of ``home`` with ``every``, distinct fingerprints, connect."""
    label = np.arange(len(every))
    at = np.searchsorted(every, home)
    bits = every.view(np.uint64)
    for i in at.tolist():
        linked = np.nonzero(np.bitwise_count(bits ^ bits[i]) <= max_bits)[0]  # itself included
        roots = np.unique(label[linked])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    moved = np.nonzero(label != np.arange(len(every)))[0]
    return every[label[moved]], every[moved]


def _hot_links(max_bits: int):
    """Forests of the groups ``(half, cell, chunk)`` of rows ``(half, cell, chunk, fp, mine)`` that come sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> pa.RecordBatch:
            fp, mine = rows.column("fp").to_numpy(), rows.column("mine").to_numpy()
            a, b = _forest(np.unique(fp[mine]), np.unique(fp), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(k).to_numpy() for k in ("half", "cell", "chunk")])
            starts = [0, *(np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            if rest and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in ("half", "cell", "chunk")):
                yield found(pa.Table.from_batches(rest))
                rest = []
            for low, high in itertools.pairwise(starts):
                rest.append(batch.slice(low, high - low))
                if high < batch.num_rows:
                    yield found(pa.Table.from_batches(rest))
                    rest = []
        if rest:
            yield found(pa.Table.from_batches(rest))

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)`` of distinct fingerprints of ``nodes(fp)`` at ``max_bits`` or fewer differing bits (1 to 3).

    All such pairs; but of a cell of more than ``HOME`` fingerprints, edges that connect what its pairs
    connect, each node's to the least it reaches there.
    """
    if not 0 < max_bits <= 3:
        raise ValueError("the two half grids find pairs of up to 3 differing bits")
    cells, steps = _cells(nodes, 2 if nodes.count() <= WIDE_MAX else 1)
    own = cells.select("half", "cell", "fp")
    near = cells.where("NOT odd").selectExpr("half", f"explode({steps}) AS cell", "fp")
    hot = cut(own.groupBy("half", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOME))
    forest = None
    if not hot.isEmpty():
        chunks = _few(hot.select("half", "cell", F.ceil(F.col("n") / HOME_CHUNK).cast("int").alias("chunks")))
        every = own.withColumn("home", F.lit(True)).unionByName(near.withColumn("home", F.lit(False))).join(chunks, ["half", "cell"])
        every = every.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        every = every.withColumn("mine", F.col("home") & (F.expr("int(pmod(xxhash64(fp), chunks))") == F.col("chunk")))
        dealt = every.select("half", "cell", "chunk", "fp", "mine").repartition("half", "cell", "chunk").sortWithinPartitions("half", "cell", "chunk")
        forest = dealt.mapInArrow(_hot_links(max_bits), "a long, b long")
        hot = _few(hot.select("half", "cell"))
        own, near = own.join(hot, ["half", "cell"], "left_anti"), near.join(hot, ["half", "cell"], "left_anti")
    other = own.selectExpr("half AS half2", "cell AS cell2", "fp AS b")
    close = (F.col("half") == F.col("half2")) & (F.col("cell") == F.col("cell2")) & (F.expr("bit_count(a ^ b)") <= max_bits)
    same = own.withColumnRenamed("fp", "a").join(other, close & (F.col("a") < F.col("b"))).select("a", "b")
    beside = near.withColumnRenamed("fp", "a").join(other, close).selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    found = same.unionByName(beside)
    return (found.unionByName(forest.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")) if forest is not None else found).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_bits: int) -> DataFrame:
    """``(doc_id, text_key, fp, component_id, root)``; ``root`` is a fingerprint that names the component."""
    rows = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    joined = components(links(nodes.select("fp"), max_bits))
    linked = nodes.join(joined, F.col("fp") == F.col("node")).select("fp", "low", "component")
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = linked.join(lows, "component").select("fp", "component_id", F.col("component").alias("root"))
    named = cut(nodes.join(named, "fp", "left").selectExpr("fp AS fp2", "coalesce(component_id, low) AS component_id", "coalesce(root, fp) AS root"))
    return spread_join(rows, named, "fp", "fp2", ["doc_id", "text_key"]).drop("fp2")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    Null or wordless texts have fingerprint 0 and link like any other; rows repeat as they do in
    the input; an empty input gives no rows; a null id never names a component unless all ids of
    the component are null.
    """
    return _grouped(docs, id_col, text_col, max_bits).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, null_ids: bool = False) -> DataFrame:
    """One row of ``docs`` for each component: the one with its smallest id, with all its columns.

    A null id names no component. With ``null_ids`` it comes after all others, so that a component
    without any id keeps a row as well; else rows without an id never stay. Texts of one component
    under its smallest id are told apart by a hash, of which the smallest stays; exact repeats of the
    kept row collapse to one. Different texts under one id that do not link stay, each for its
    component. An empty input gives no rows.

    Texts are not shuffled for it: the keys of the rows that go, and of those that stay but repeat, are
    found first. They are broadcast up to ``BROADCAST`` rows, else joined.
    """
    docs, named_back = plain_names(docs, [id_col, text_col])
    found = _grouped(docs, id_col, text_col, max_bits)
    found = cut(found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")))
    able = found if null_ids else found.where("doc_id IS NOT NULL")
    best = able.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best")).withColumnRenamed("root", "root2")
    stays = F.coalesce(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")), F.lit(False))
    judged = found.join(best, F.col("root") == F.col("root2"), "left").withColumn("stays", F.col("best").isNotNull() & stays)
    # A row's key is that of its id and text; hashes are joined, and ids and texts' hashes compared.
    judged = cut(judged.where("NOT stays OR n > 1").select(F.xxhash64("doc_id", "text_key").alias("__sh_key"), F.col("doc_id").alias("__sh_id"), F.col("text_key").alias("__sh_text"), F.col("stays").alias("__sh_stays")))
    own_id, own_text = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.withColumn("__sh_own_text", own_text).withColumn("__sh_own", F.xxhash64(own_id, F.col("__sh_own_text")))
    same = (F.col("__sh_own") == F.col("__sh_key")) & own_id.eqNullSafe(F.col("__sh_id")) & (F.col("__sh_own_text") == F.col("__sh_text"))
    once = rows.join(_few(judged), same, "left_anti")
    again = rows.join(_few(judged.where("__sh_stays")), same, "left_semi").dropDuplicates(["__sh_own"])
    return named_back(once.unionByName(again))
