"""Packed token files: a flat little-endian array (.bin) with a JSON index (.idx) per partition.

Parquet with ``tokens ARRAY<INT>`` is the engine's own form; this is the exchange format. Ids take 2
bytes if all fit, else 4, and the reader follows the index.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.plans.durable import cut

WIDTH = {"uint16": 2, "uint32": 4}
#: Ids that a part holds, about.
PART_IDS = 1 << 28
#: Ids of a batch that a reader hands to Spark, about; a longer document is a batch of its own.
BATCH_IDS = 1 << 19


def runs(bounds: np.ndarray, ids: int) -> Iterator[tuple[int, int]]:
    """``(low, high)``: documents by their bounds, one after another, as many at a time as have ``ids`` ids, one at least."""
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + ids, side="right")) - 1)
        yield low, high
        low = high


def write_packed(tokens: DataFrame, folder: str, order: str = "doc_id", source: str | None = None, parts: int | None = None) -> DataFrame:
    """Writes parts of ascending ``order`` and returns the manifest ``(part, path, num_documents, total_tokens, dtype)``.

    With ``source`` the index also has the number of documents of each source. ``folder`` is a URI
    that every executor reaches; a task that runs again writes files of another name.
    """
    columns = [order, "tokens", *([source] if source else [])]
    # Cut, so that ids are computed once for their width, the ranges and the files.
    tokens = cut(tokens.select(*columns))
    facts = tokens.agg(F.max(F.array_max("tokens")).alias("top"), F.sum(F.size("tokens").cast("long")).alias("n")).first()
    dtype = "uint16" if (facts.top or 0) < 1 << 16 else "uint32"
    parts = parts or max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(facts.n or 0) // PART_IDS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        part = TaskContext.get().partitionId()
        stem = f"part-{part:06d}-{uuid.uuid4().hex}"
        bounds, sources = [0], {}
        with fs.open_output_stream(f"{base}/{stem}.bin") as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                    out.write(ids.astype(f"<u{WIDTH[dtype]}").tobytes())
                    bounds.append(bounds[-1] + len(ids))
                    if source:
                        name = str(batch.column(2)[i].as_py())
                        sources[name] = sources.get(name, 0) + 1
        index = {"num_documents": len(bounds) - 1, "total_tokens": bounds[-1], "dtype": dtype, "document_boundaries": bounds}
        with fs.open_output_stream(f"{base}/{stem}.idx") as out:
            out.write(json.dumps(index | ({"source_distribution": sources} if source else {})).encode())
        values = (pa.array([part], pa.int32()), pa.array([f"{folder}/{stem}"]), pa.array([len(bounds) - 1]), pa.array([bounds[-1]]), pa.array([dtype]))
        yield pa.RecordBatch.from_arrays(list(values), ["part", "path", "num_documents", "total_tokens", "dtype"])

    rows = tokens.repartitionByRange(parts, order).sortWithinPartitions(order)
    found = rows.mapInArrow(write, "part int, path string, num_documents long, total_tokens long, dtype string").collect()
    kinds = "part int, path string, num_documents long, total_tokens long, dtype string"
    return tokens.sparkSession.createDataFrame(sorted(map(tuple, found)), kinds)


def distribution(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``(source, documents)``: the numbers of documents of each source that the indexes of a manifest hold, added up."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = PackedFile(path).index.get("source_distribution", {})
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["source", "n"])

    return manifest.select("path").mapInArrow(read, "source string, n long").groupBy("source").agg(F.sum("n").alias("documents"))


class PackedFile:
    """Random access to one packed file by its stem."""

    def __init__(self, stem: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(stem)
        with fs.open_input_stream(f"{path}.idx") as f:
            self.index = json.loads(f.read())
        self.file, self.width = fs.open_input_file(f"{path}.bin"), WIDTH[self.index["dtype"]]
        self.bounds = self.index["document_boundaries"]

    def __len__(self) -> int:
        return self.index["num_documents"]

    def get_document(self, i: int) -> np.ndarray:
        return self.get_ids(i, i + 1)

    def get_ids(self, first: int, end: int) -> np.ndarray:
        """Ids of the documents from ``first`` to below ``end``, one after another."""
        low, high = self.bounds[first], self.bounds[end]
        return np.frombuffer(self.file.read_at((high - low) * self.width, low * self.width), f"<u{self.width}")


def read_packed(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``(part, doc, tokens)`` of all files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = PackedFile(row["path"])
                bounds = np.array(file.bounds, np.int64)
                for low, high in runs(bounds, BATCH_IDS):
                    places = pa.array(bounds[low : high + 1] - bounds[low], pa.int32())
                    tokens = pa.ListArray.from_arrays(places, pa.array(file.get_ids(low, high).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * (high - low), pa.int32()), pa.array(range(low, high), pa.int64()), tokens], ["part", "doc", "tokens"])

    return manifest.select("part", "path").repartition(max(1, manifest.count())).mapInArrow(read, "part int, doc long, tokens array<long>")


def concatenated(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of all parts with ``doc_id`` in the order of the parts, as one stream."""
    bases, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        bases.append((r.part, base))
        base += r.num_documents
    starts = spark.createDataFrame(bases, "part int, base long")
    return read_packed(spark, manifest).join(starts, "part").select((F.col("base") + F.col("doc")).alias("doc_id"), "tokens")
