"""Tensor shards written by hand, and counts in the order of a counter."""

import json
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import ranking
from corpuskit.sources import tensors


def shard(path, entries, metadata=None):
    """A file of the layout from ``name -> (dtype, array)``, written without the library."""
    head, data = {"__metadata__": metadata} if metadata else {}, b""
    for name, (dtype, x) in entries.items():
        raw = x.tobytes()
        head[name] = {"dtype": dtype, "shape": list(x.shape), "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    text = json.dumps(head).encode() + b"   "
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + data)


@pytest.fixture()
def folder(tmp_path):
    w = np.arange(60, dtype="<f4").reshape(12, 5)
    shard(tmp_path / "m-1.safetensors", {"w": ("F32", w), "b": ("I64", np.array([7], "<i8")), "old": ("F16", np.array([1.5, -2], "<f2"))}, {"format": "x"})
    half = np.array([1.0, -3.5, 2.0**100], "<f4")
    shard(tmp_path / "m-2.safetensors", {"b": ("I64", np.array([1, 2, 3], "<i8")), "h": ("BF16", (half.view("<u4") >> 16).astype("<u2")), "none": ("F32", np.zeros((0, 3), "<f4")), "one": ("F64", np.array(4.25, "<f8"))})
    (tmp_path / "notes.txt").write_text("no shard")
    return f"file://{tmp_path}"


def test_headers_and_slices(spark, folder):
    listed = {(r.shard, r.name): (r.dtype, r.shape, r.values) for r in tensors.load(spark, folder, data=False).collect()}
    assert listed["m-1.safetensors", "w"] == ("F32", [12, 5], None) and len(listed) == 7
    assert listed["m-2.safetensors", "one"] == ("F64", [], None) and listed["m-2.safetensors", "none"][1] == [0, 3]
    cut = [r for r in tensors.load(spark, folder, sliceBytes="41").collect() if r.name == "w"]
    assert len(cut) == 6 and all(r.high - r.low == 2 for r in cut)
    assert [v for r in sorted(cut, key=lambda r: r.low) for v in r.values] == list(map(float, range(60)))
    values = {(r.shard[2], r.name): r.values for r in tensors.load(spark, folder).collect()}
    assert values["1", "old"] == [1.5, -2.0] and values["2", "h"] == [1.0, -3.5, 2.0**100] and values["2", "one"] == [4.25] and values["2", "none"] == []


def test_last_shard_wins_and_named_tensors_alone_are_read(spark, folder):
    rows = tensors.load(spark, folder)
    assert {r.name: r.values for r in tensors.merged(rows, tensors.load(spark, folder, data=False)).collect()}["b"] == [1.0, 2.0, 3.0]
    one = tensors.load(spark, folder, names=["h"])
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    assert tensors.load(spark, folder, names=["b", "gone"]).count() == 2 and tensors.load(spark, folder, names=[]).count() == 0
    assert rows.where("name = 'h'").count() == 1 and rows.count() == 7
    means = {r.name: r.mean for r in rows.groupBy("name").agg(F.avg(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)).alias("mean")).collect()}
    assert means["w"] == sum(range(60))


def test_broken_shards(spark, tmp_path):
    with pytest.raises(Exception, match="no shards"):
        tensors.load(spark, f"file://{tmp_path}").count()
    for body in (b"", b"\1\2", struct.pack("<Q", 10**6) + b"{}", struct.pack("<Q", 64) + json.dumps({"a": {"dtype": "F32", "shape": [4], "data_offsets": [0, 16]}}).encode().ljust(64)):
        (tmp_path / "x.safetensors").write_bytes(body)
        with pytest.raises(Exception, match="header|broken"):
            tensors.load(spark, f"file://{tmp_path}").count()


def test_saved_shards(spark, tmp_path):
    tensors.save([("a", "F32", [2, 2], np.arange(4, dtype="<f4").tobytes()), ("b", "I32", [1], np.array([9], "<i4").tobytes())], f"file://{tmp_path}/s.safetensors")
    assert {r.name: r.values for r in tensors.load(spark, f"file://{tmp_path}").collect()} == {"a": [0.0, 1.0, 2.0, 3.0], "b": [9.0]}


def test_most_common_is_a_counter(spark):
    rng = random.Random(2)
    values = [rng.choice("abcdefghijkl") for _ in range(60)] + [None, None]
    rows = spark.createDataFrame([(f"f{i // 20}", i % 20, v, i % 2) for i, v in enumerate(values)], "file string, line int, v string, g int").repartition(5)
    want = Counter(values).most_common()
    got = sorted(ranking.most_common(rows, "v", ["file", "line"]).collect(), key=lambda r: r["rank"])
    assert [(r.value, r.n) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))
    assert len(set(n for _, n in want)) < len(want)  # ties
    three = ranking.most_common(rows, "v", ["file", "line"], 3, by=["g"]).collect()
    for g in (0, 1):
        mine = sorted((r["rank"], r.value, r.n) for r in three if r.g == g)
        assert mine == [(i + 1, v, n) for i, (v, n) in enumerate(Counter(values[g::2]).most_common(3))]
    assert ranking.most_common(rows.limit(0), "v", ["line"]).count() == 0


def test_reasons_as_first_seen(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "a"), (5, "b"), (6, "c")], "doc_id long, reason string").repartition(3)
    got = sorted(ranking.reason_counts(rows, ["doc_id"]).collect(), key=lambda r: r["rank"])
    assert [(r.value, r.n) for r in got] == [("b", 2), ("a", 2), ("c", 1)]
