"""Lexical retrieval packing: documents fill sequences of a fixed length together with their BM25 neighbours.

Texts are encoded once. A document's whole windows are sequences of their own; what is left of it,
fewer ids than a window has, is a unit. Units are dealt into shards of about ``UNITS``, ranges
of a lexical key (two least hashes of a unit's terms), so that similar units meet in a shard, and a
group of copies of any size is dealt on by row number. A shard has an inverted index of its units,
weighted by BM25 with counts over all documents. The first unused unit is a seed; the
index gives its unused neighbours, best first, which fill its window. The last one is cut, and its rest
is the next seed. So every sequence is full but for a shard's last, which is cut into powers of two.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.sstable import _coder
from corpuskit.plans.durable import shared_dir

WINDOW = 4096
END_ID = 2
UNITS = 1024
K1, B = 1.2, 0.75
SEED = 11
#: Kinds of rows of the encoded table.
WHOLE, UNIT, STATS = 0, 1, 2
ENCODED = "kind int, doc_id long, row long, start long, length long, doc_tokens long, ids_crc32 long, sequence_id long, ids binary, key long, n_docs long, terms array<int>, counts array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def sequence_number(part: int, n: int, of_shard: bool) -> int:
    """A number of its own for the n-th sequence of a task; those of shards and of whole windows never meet."""
    return (part << 32 | n) << 1 | of_shard


class _Terms:
    """Distinct terms of documents, and how many documents have each."""

    def __init__(self, size: int):
        self.mark, self.docs = np.zeros(size, np.int64), np.zeros(size, np.int64)
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.hashes = [rng.permutation(size).astype(np.int64) for _ in range(2)]

    def distinct(self, ids: np.ndarray) -> np.ndarray:
        places = np.arange(len(ids))
        self.mark[ids] = places
        return ids[self.mark[ids] == places]

    def key(self, terms: np.ndarray) -> int:
        """A unit's place among the others: the least hashes of its terms, last without any."""
        return int(self.hashes[0][terms].min()) << 32 | int(self.hashes[1][terms].min()) if len(terms) else 2**63 - 1


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", whole_ids: bool = False) -> DataFrame:
    """Whole windows, units with their ids, and a row of statistics for each task, written to the shared folder."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        kind = np.dtype(f"<u{coder.width}")
        terms, n_docs, n_whole = _Terms(coder.tokenizer.get_vocab_size()), 0, 0
        names = ["kind", "doc_id", "row", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "ids", "key", "n_docs", "terms", "counts"]
        types = [pa.int32(), *[pa.int64()] * 7, pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            out, size = [], 0
            for doc_id, row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), coder.encode(batch.column(2))):
                words = np.frombuffer(value, kind)[:-1]  # without the end id of the coder
                ids = np.append(words, kind.type(end_id))
                n, n_docs = len(ids), n_docs + 1
                own = terms.distinct(words)
                terms.docs[own] += 1
                rest = n // window * window
                for at in range(0, rest, window):
                    number, n_whole = sequence_number(row >> 33, n_whole, False), n_whole + 1
                    part = ids[at : at + window]
                    out.append((WHOLE, doc_id, row, at, window, n, crc(part), number, part.tobytes() if whole_ids else None, None, None, None, None))
                if rest < n:
                    part = ids[rest:]
                    own = own if not rest else terms.distinct(words[rest:])
                    out.append((UNIT, doc_id, row, rest, len(part), n, None, None, part.tobytes(), terms.key(own), None, None, None))
                size += n
                if size > 1 << 22:
                    yield table(out)
                    out, size = [], 0
            yield table(out)
        if n_docs:
            some = np.nonzero(terms.docs)[0]
            yield table([(STATS, *[None] * 9, n_docs, some.tolist(), terms.docs[some].tolist())])

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    folder = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    rows.mapInArrow(run, ENCODED).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(ENCODED).parquet(folder)


def idf(n_docs: int, docs: np.ndarray) -> np.ndarray:
    """BM25's weights of terms by their numbers of documents; terms that half of all documents have weigh nothing."""
    return np.maximum(0, np.log((n_docs - docs + 0.5) / (docs + 0.5)))


class Index:
    """Inverted index of the units of a shard."""

    def __init__(self, units: list[np.ndarray], weights: np.ndarray, mean: float):
        n, sizes = len(units), np.array([len(x) for x in units])
        flat = np.concatenate(units).astype(np.int64) if n else np.zeros(0, np.int64)
        unit = np.repeat(np.arange(n), sizes)
        weighed = weights[flat] > 0
        pairs, counts = np.unique(flat[weighed] * n + unit[weighed], return_counts=True)
        self.n, self.unit = n, pairs % max(n, 1)
        term = pairs // max(n, 1)
        self.starts = np.searchsorted(term, np.arange(len(weights) + 1))
        length = 1 - B + B * sizes[self.unit] / mean
        self.weight = weights[term] * counts * (K1 + 1) / (counts + K1 * length)
        by_unit = np.argsort(self.unit, kind="stable")
        self.terms, self.places = term[by_unit], np.searchsorted(self.unit[by_unit], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all units for the distinct terms of one of them."""
        terms = self.terms[self.places[seed] : self.places[seed + 1]]
        first, n = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.unit[at], self.weight[at], self.n)


def fill(index: Index, sizes: list[int], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as ``(unit, start, length)``, start being a place in the unit; each id of each unit is in one of them."""
    used, begun, seed, unused = np.zeros(len(sizes), bool), 0, None, 0
    while True:
        while unused < len(sizes) and used[unused]:
            unused += 1
        if seed is None:
            if unused == len(sizes):
                return
            seed, begun = unused, 0
        used[seed] = True
        room, pieces = window - (sizes[seed] - begun), [(seed, begun, sizes[seed] - begun)]
        seed_now, seed = seed, None
        if room:
            scores = np.where(used, -1, index.scores(seed_now))
            order = np.argsort(-scores, kind="stable")
            for u in order[: len(order) - int(used.sum())].tolist():
                used[u] = True
                take = min(room, sizes[u])
                pieces.append((u, 0, take))
                room -= take
                if take < sizes[u]:
                    seed, begun = u, take
                if not room:
                    break
        if not room:
            yield pieces
            continue
        # The shard's last: cut into sequences of powers of two, which need no padding.
        total, stream = window - room, iter(pieces)
        unit, start, left = next(stream)
        for bit in reversed(range(total.bit_length())):
            want, out = total & 1 << bit, []
            while want:
                if not left:
                    unit, start, left = next(stream)
                take = min(want, left)
                out.append((unit, start, take))
                start, left, want = start + take, left - take, want - take
            if out:
                yield out


def _packed(shared, width: int, window: int, with_ids: bool):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        weights, mean = shared.value
        units = [np.frombuffer(r["ids"], kind) for r in rows]
        index, out = Index([u[:-1] for u in units], weights, mean), []
        for n, pieces in enumerate(fill(index, [len(u) for u in units], window)):
            number, offset = sequence_number(rows[0]["shard"], n, True), 0
            for u, start, length in pieces:
                ids, row = units[u][start : start + length], rows[u]
                out.append((row["doc_id"], row["start"] + start, length, crc(ids), row["doc_tokens"], number, offset, *([ids.tobytes()] if with_ids else [])))
                offset += length
        names = [c.split()[0] for c in PIECES.split(", ")] + (["ids"] if with_ids else [])
        kinds = [*[pa.int64()] * 7, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, window: int = WINDOW, units: int = UNITS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, a row per piece of a document.

    With ``with_ids`` a piece also has its ids, little-endian in 2 bytes each, or 4 if the vocabulary
    takes them. Null text is empty: its document is the end id alone. Rows that repeat an id, and rows
    without one, are documents of their own. Units without any weighed term have no neighbours; after
    the last neighbour a window is filled with units in the shard's order, as ties are. No rows give no
    rows. Other columns have no part in it.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    table = encoded(docs, tokenizer_path, end_id, window, id_col, text_col, with_ids)
    stats = table.where(F.col("kind") == STATS)
    n_docs = stats.agg(F.sum("n_docs").alias("n")).first().n or 0
    # A row per term of the vocabulary at most.
    counts = stats.select(F.arrays_zip("terms", "counts").alias("x")).select(F.inline("x")).groupBy("terms").agg(F.sum("counts").alias("n")).toPandas()
    of_units = table.where(F.col("kind") == UNIT)
    facts = of_units.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    with open(tokenizer_path, encoding="utf-8") as f:
        coder = _coder(f.read())
    found = np.zeros(coder.tokenizer.get_vocab_size(), np.int64)
    found[counts["terms"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((idf(n_docs, found), facts["mean"] or 1.0))
    order = ["key", "row"]
    shards = of_units.select("doc_id", "row", "start", "doc_tokens", "ids", "key").repartitionByRange(max(1, -(-facts.n // units)), *order).sortWithinPartitions(*order)
    shards = shards.select("doc_id", "start", "doc_tokens", "ids", F.spark_partition_id().alias("shard"))
    kind = PIECES + (", ids binary" if with_ids else "")
    pieces = shards.mapInArrow(_packed(shared, coder.width, window, with_ids), kind)
    names = [c.split()[0] for c in kind.split(", ")]
    return pieces.unionByName(table.where(F.col("kind") == WHOLE).withColumn("offset", F.lit(0).cast("long")).select(*names))
