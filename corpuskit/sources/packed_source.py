"""``format("packed")``: sets of packed token files as a Spark source and sink.

A part is ``.bin``, little-endian ids one after another, ``.idx``, its JSON index in the exchange
format, and ``.bnd``, the places where its documents begin as 8-byte integers, so that one document
is read by two small reads. A write's parts count once its manifest lists them; what failed tasks
left is removed at the end of the write. Parts without any manifest are read in the order of their
names. Folders are URIs that the driver and all executors reach.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from corpuskit.sources.packed import BATCH_IDS, WIDTH, runs

#: Bytes of ids of a reading task, about.
RANGE_BYTES = 128 << 20
MANIFEST = re.compile(r"_manifest-\d{6}\.json")


@dataclass
class Part(WriterCommitMessage):
    """A written part: its task's number, the name of its files without their ends, its documents and ids."""

    number: int
    stem: str
    num_documents: int
    total_tokens: int
    dtype: str


@dataclass
class Range(InputPartition):
    """Documents from ``low`` to below ``high`` of a part whose first document has the number ``base``."""

    stem: str
    dtype: str
    base: int
    low: int
    high: int
    only: tuple[int, ...] | None = None


def _names(fs: pyarrow.fs.FileSystem, base: str) -> list[str]:
    return sorted(x.base_name for x in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)) if x.is_file)


def _json(fs: pyarrow.fs.FileSystem, path: str):
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, dtype: str, overwrite: bool):
        if "tokens" not in schema.names:
            raise ValueError("a packed set needs a column tokens")
        if dtype not in WIDTH:
            raise ValueError(f"dtype must be one of {', '.join(WIDTH)}")
        self.folder, self.dtype, self.overwrite, self.with_source = folder, dtype, overwrite, "source" in schema.names
        self.job = uuid.uuid4().hex

    def _ids(self, tokens: pa.ListArray) -> np.ndarray:
        ids = tokens.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 8 * WIDTH[self.dtype]):
            raise ValueError(f"an id does not fit {self.dtype}")
        return ids.astype(f"<u{WIDTH[self.dtype]}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(base)
        number = TaskContext.get().partitionId()
        stem = f"part-{self.job}-{number:06d}-{uuid.uuid4().hex[:8]}"
        bounds, sources = array("q", [0]), {}
        with fs.open_output_stream(f"{base}/{stem}.bin") as out:
            for batch in iterator:
                tokens = batch.column("tokens")
                ends = np.append(0, np.cumsum(tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)))
                for low, high in runs(ends, BATCH_IDS):
                    out.write(self._ids(tokens.slice(low, high - low)).tobytes())
                bounds.frombytes((ends[1:] + bounds[-1]).tobytes())
                if self.with_source:
                    for pair in batch.column("source").value_counts().to_pylist():
                        name = str(pair["values"])
                        sources[name] = sources.get(name, 0) + pair["counts"]
        with fs.open_output_stream(f"{base}/{stem}.bnd") as out:
            out.write(np.frombuffer(bounds, np.int64).astype("<i8").tobytes())
        head = {"num_documents": len(bounds) - 1, "total_tokens": bounds[-1], "dtype": self.dtype, **({"source_distribution": sources} if self.with_source else {})}
        with fs.open_output_stream(f"{base}/{stem}.idx") as out:
            out.write(json.dumps(head)[:-1].encode() + b', "document_boundaries": [')
            for at in range(0, len(bounds), 100_000):
                out.write((", " if at else "").encode() + ", ".join(map(str, bounds[at : at + 100_000])).encode())
            out.write(b"]}")
        return Part(number, stem, len(bounds) - 1, bounds[-1], self.dtype)

    def commit(self, messages: list[Part | None]) -> None:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(base)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        names = _names(fs, base)
        before = [x for x in names if MANIFEST.fullmatch(x)]
        number = 0 if self.overwrite or not before else int(before[-1][10:16]) + 1
        listed = [{"stem": m.stem, "num_documents": m.num_documents, "total_tokens": m.total_tokens, "dtype": m.dtype} for m in parts]
        with fs.open_output_stream(f"{base}/_new-{self.job}") as out:
            out.write(json.dumps(listed).encode())
        if self.overwrite:
            for name in before:
                fs.delete_file(f"{base}/{name}")
        fs.move(f"{base}/_new-{self.job}", f"{base}/_manifest-{number:06d}.json")
        stems = {m.stem for m in parts}
        self._remove(fs, base, [x for x in names if x.startswith("part-") and x.rsplit(".", 1)[0] not in stems and (self.overwrite or self.job in x)])

    def abort(self, messages: list[Part | None]) -> None:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        self._remove(fs, base, [x for x in _names(fs, base) if self.job in x])

    def _remove(self, fs: pyarrow.fs.FileSystem, base: str, names: list[str]) -> None:
        for name in names:
            fs.delete_file(f"{base}/{name}")


class PackedReader(DataSourceReader):
    """Documents from ``low`` to below ``high``, or those of ``only``; all by default."""

    def __init__(self, folder: str, range_bytes: int, low: int = 0, high: int | None = None, only: set[int] | None = None):
        self.folder, self.range_bytes, self.low, self.high, self.only = folder, range_bytes, low, high, only

    def _parts(self) -> list[dict]:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        names = _names(fs, base)
        manifests = [x for x in names if MANIFEST.fullmatch(x)]
        if manifests:
            return [part for x in manifests for part in _json(fs, f"{base}/{x}")]
        found = [(x[:-4], _json(fs, f"{base}/{x}")) for x in names if x.endswith(".idx")]
        if not found:
            raise FileNotFoundError(f"no packed set in {self.folder}")
        return [{"stem": stem, **{k: index[k] for k in ("num_documents", "total_tokens", "dtype")}} for stem, index in found]

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for part in self._parts():
            n = part["num_documents"]
            low, high = max(0, self.low - base), n if self.high is None else min(n, self.high - base)
            if self.only is not None:
                asked = tuple(sorted(x - base for x in self.only if x is not None and low <= x - base < high))
                if asked:
                    out.append(Range(part["stem"], part["dtype"], base, asked[0], asked[-1] + 1, asked))
            elif low < high:
                ranges = max(1, part["total_tokens"] * WIDTH[part["dtype"]] // self.range_bytes)
                step = -(-n // ranges)
                out += [Range(part["stem"], part["dtype"], base, max(low, at), min(high, at + step)) for at in range(0, n, step) if at < high and at + step > low]
            base += n
        return out or [Range("", "uint16", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.low == partition.high:
            return
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        path, width = f"{base}/{partition.stem}", WIDTH[partition.dtype]
        wanted = [(partition.low, partition.high)] if partition.only is None else [(x, x + 1) for x in partition.only]
        with fs.open_input_file(f"{path}.bin") as ids:
            for low, high in wanted:
                bounds = self._bounds(fs, path, low, high)
                for at, stop in runs(bounds, BATCH_IDS):
                    data = ids.read_at(int(bounds[stop] - bounds[at]) * width, int(bounds[at]) * width)
                    tokens = pa.LargeListArray.from_arrays(bounds[at : stop + 1] - bounds[at], np.frombuffer(data, f"<u{width}").astype(np.int64))
                    numbers = np.arange(low + at, low + stop) + partition.base
                    yield pa.RecordBatch.from_arrays([pa.array(numbers), tokens.cast(pa.list_(pa.int64()))], ["doc", "tokens"])

    def _bounds(self, fs: pyarrow.fs.FileSystem, path: str, low: int, high: int) -> np.ndarray:
        """Places of the documents from ``low`` to ``high``, the end of the last included."""
        if fs.get_file_info(f"{path}.bnd").type == pyarrow.fs.FileType.NotFound:
            return np.array(_json(fs, f"{path}.idx")["document_boundaries"][low : high + 1], np.int64)
        with fs.open_input_file(f"{path}.bnd") as f:
            return np.frombuffer(f.read_at((high - low + 1) * 8, low * 8), "<i8")


class PackedSource(DataSource):
    """``(doc, tokens)`` by document number over all parts; writes ``tokens`` and counts ``source``, if there is one.

    Options: ``path``, ``dtype`` (uint16, or uint32 for ids over 65,535, which else are an error),
    ``rangeBytes`` (bytes of ids a task reads), and ``from``, ``to`` (not included) or ``docs`` (numbers with
    commas between), which choose what is read. These are options and not filters that Spark pushes
    down, as it keeps a pushed filter's ranges for later queries on the same DataFrame. Null tokens
    are an empty document.
    """

    @classmethod
    def name(cls) -> str:
        return "packed"

    def _folder(self) -> str:
        if "path" not in self.options:
            raise ValueError("a packed set needs a path")
        return self.options["path"]

    def schema(self) -> str:
        return "doc bigint, tokens array<bigint>"

    def reader(self, schema: StructType) -> PackedReader:
        o = self.options
        only = {int(x) for x in o["docs"].split(",") if x.strip()} if "docs" in o else None
        high = int(o["to"]) if "to" in o else None
        return PackedReader(self._folder(), int(o.get("rangeBytes", RANGE_BYTES)), int(o.get("from", 0)), high, only)

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(self._folder(), schema, self.options.get("dtype", "uint16"), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("packed")`` known to a session."""
    spark.dataSource.register(PackedSource)


def save(tokens: DataFrame, folder: str, order: str = "doc_id", dtype: str = "uint16", parts: int | None = None, mode: str = "overwrite") -> None:
    """Writes ``tokens`` in ascending ``order``; documents are numbered in it."""
    spark = tokens.sparkSession
    register(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tokens.repartitionByRange(parts, order).sortWithinPartitions(order)
    kept = [c for c in ("tokens", "source") if c in tokens.columns]
    rows.select(*kept).write.format("packed").option("dtype", dtype).mode(mode).save(folder)


def load(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("packed").options(**options).load(folder)


def documents(spark: SparkSession, folder: str, numbers: list[int]) -> DataFrame:
    """Documents by number, each by a small read of its own place; numbers beyond the set have no row."""
    return load(spark, folder, docs=",".join(map(str, numbers)))
