"""``format("tensorshards")``: tensor shards in the safetensors layout, as rows.

A shard begins with the size of its header in 8 bytes and the header, JSON that gives each tensor's type,
shape and place. The header alone is read to list tensors; data comes in slices of whole rows of the
first axis, a task for each of about ``sliceBytes``, so that no tensor has to fit a task.
"""

from __future__ import annotations

import fnmatch
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# The layout's names of types, and the numpy type of each; bfloat16 is widened by its bits.
TYPES = {
    "F64": "<f8",
    "F32": "<f4",
    "F16": "<f2",
    "BF16": "<u2",
    "I64": "<i8",
    "I32": "<i4",
    "I16": "<i2",
    "I8": "<i1",
    "U8": "<u1",
    "BOOL": "<u1",
}
#: A header of more bytes is taken for a broken file, as writers hold to it.
HEADER_BYTES = 100_000_000
SLICE_BYTES = 32 << 20


@dataclass
class Slice(InputPartition):
    """Rows ``low`` to below ``high`` of a tensor's first axis; ``at`` is where the tensor's data begins in its file."""

    shard: str
    name: str
    dtype: str
    shape: tuple[int, ...]
    at: int
    low: int
    high: int


def header(fs: pyarrow.fs.FileSystem, path: str) -> tuple[dict, int]:
    """Tensors of a shard by name, and where its data begins; an error for a file of another layout."""
    with fs.open_input_file(path) as f:
        size = f.size()
        length = struct.unpack("<Q", f.read_at(8, 0))[0] if size >= 8 else size
        if length > min(HEADER_BYTES, size - 8):
            raise ValueError(f"{path}: no header")
        found = json.loads(f.read_at(length, 8))
    found.pop("__metadata__", None)
    for name, x in found.items():
        low, high = x["data_offsets"]
        if x["dtype"] not in TYPES or not 0 <= low <= high <= size - 8 - length or high - low != _bytes(x["dtype"], x["shape"]):
            raise ValueError(f"{path}: the entry of {name} is broken")
    return found, 8 + length


def _bytes(dtype: str, shape: list[int]) -> int:
    return int(np.prod(shape, dtype=np.int64)) * np.dtype(TYPES[dtype]).itemsize


def values_of(data: bytes, dtype: str) -> np.ndarray:
    """Numbers as doubles."""
    found = np.frombuffer(data, TYPES[dtype])
    return (found.astype(np.uint32) << 16).view(np.float32).astype(np.float64) if dtype == "BF16" else found.astype(np.float64)


class TensorReader(DataSourceReader):
    def __init__(self, folder: str, pattern: str, slice_bytes: int, with_data: bool, names: set[str] | None):
        self.folder, self.pattern, self.slice_bytes, self.with_data, self.names = folder, pattern, slice_bytes, with_data, names

    def partitions(self) -> list[Slice]:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        files = sorted(x.base_name for x in fs.get_file_info(pyarrow.fs.FileSelector(base)) if x.is_file and fnmatch.fnmatch(x.base_name, self.pattern))
        if not files:
            raise FileNotFoundError(f"no shards {self.pattern} in {self.folder}")
        out = []
        for shard in files:
            tensors, begin = header(fs, f"{base}/{shard}")
            for name, x in tensors.items():
                if self.names is None or name in self.names:
                    rows = x["shape"][0] if x["shape"] else 1
                    size = _bytes(x["dtype"], x["shape"])
                    step = max(1, rows * self.slice_bytes // max(size, 1)) if self.with_data else max(1, rows)
                    out += [Slice(shard, name, x["dtype"], tuple(x["shape"]), begin + x["data_offsets"][0], at, min(rows, at + step)) for at in range(0, max(1, rows), step)]
        return out or [Slice("", "", "U8", (), 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.shard:
            return
        values = None
        if self.with_data:
            fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
            row = _bytes(p.dtype, list(p.shape[1:]))
            with fs.open_input_file(f"{base}/{p.shard}") as f:
                values = values_of(f.read_at((p.high - p.low) * row, p.at + p.low * row), p.dtype)
        columns = [
            pa.array([p.shard]),
            pa.array([p.name]),
            pa.array([p.dtype]),
            pa.array([list(p.shape)], pa.list_(pa.int64())),
            pa.array([p.low], pa.int64()),
            pa.array([p.high], pa.int64()),
            pa.array([values], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "name", "dtype", "shape", "low", "high", "values"])


class TensorShards(DataSource):
    """``(shard, name, dtype, shape, low, high, values)``, a row per slice of a tensor.

    Options: ``path``, ``pattern`` (of file names, ``*.safetensors``), ``data`` (false lists tensors
    without their values, a row each), ``sliceBytes``, ``names`` (a JSON list of the tensors to read).
    """

    @classmethod
    def name(cls) -> str:
        return "tensorshards"

    def schema(self) -> str:
        return "shard string, name string, dtype string, shape array<bigint>, low bigint, high bigint, values array<double>"

    def reader(self, schema: StructType) -> TensorReader:
        o = self.options
        if "path" not in o:
            raise ValueError("tensor shards need a path")
        names = set(json.loads(o["names"])) if "names" in o else None
        return TensorReader(o["path"], o.get("pattern", "*.safetensors"), int(o.get("sliceBytes", SLICE_BYTES)), o.get("data", "true").lower() == "true", names)


def load(spark: SparkSession, folder: str, data: bool = True, names: list[str] | None = None, **options: str) -> DataFrame:
    """All slices of all shards, or of the tensors named."""
    options |= {} if names is None else {"names": json.dumps(names)}
    spark.dataSource.register(TensorShards)
    return spark.read.format("tensorshards").options(data=str(data).lower(), **options).load(folder)


def merged(slices: DataFrame, listed: DataFrame) -> DataFrame:
    """The slices of each tensor's last shard by file name; ``listed`` are the same shards without data."""
    last = listed.groupBy(F.col("name").alias("name2")).agg(F.max("shard").alias("shard2"))
    return slices.join(last, (F.col("name") == F.col("name2")) & (F.col("shard") == F.col("shard2")), "left_semi")


def save(rows: list[tuple[str, str, list[int], bytes]], path: str) -> None:
    """One shard from ``(name, dtype, shape, data)``, for small tables of tensors such as tests and exports have."""
    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    entries, at = {}, 0
    for name, dtype, shape, data in rows:
        entries[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at += len(data)
    head = json.dumps(entries).encode()
    with fs.open_output_stream(base) as out:
        out.write(struct.pack("<Q", len(head)) + head + b"".join(r[3] for r in rows))
