"""Packed sets as a Spark source: round trips, documents by number, failed writes, foreign files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.sources import packed_source as P


def tokens(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, tokens array<long>, source string, `a.b` int").repartition(parts)


def rows(n=200, top=65_536):
    rng = np.random.default_rng(1)
    out = [(i * 2, rng.integers(0, top, rng.integers(0, 40)).tolist(), f"s{i % 3}" if i % 7 else None, 1) for i in range(n)]
    return [*out, (1001, [], "s0", 1), (1003, None, "s1", 1), (1005, [0, 65_535], "s0", 1)]


def test_round_trip(spark, tmp_path):
    data = rows()
    P.save(tokens(spark, data), f"file://{tmp_path}/set", parts=4)
    back = P.load(spark, f"file://{tmp_path}/set").orderBy("doc").collect()
    assert [(r.doc, r.tokens) for r in back] == [(i, r[1] or []) for i, r in enumerate(sorted(data))]
    found = [json.load(open(f"{tmp_path}/set/{x}")) for x in os.listdir(f"{tmp_path}/set") if x.endswith(".idx")]
    assert sum(x["num_documents"] for x in found) == len(data) and {x["dtype"] for x in found} == {"uint16"}
    counts = {}
    for x in found:
        assert x["document_boundaries"][0] == 0 and len(x["document_boundaries"]) == x["num_documents"] + 1
        for source, n in x["source_distribution"].items():
            counts[source] = counts.get(source, 0) + n
    want = tokens(spark, data).groupBy(F.coalesce("source", F.lit("None")).alias("s")).count().collect()
    assert counts == {r.s: r["count"] for r in want}


def test_wide_ids(spark, tmp_path):
    wide = [(i, [i, 70_000 + i, 2**32 - 1], "s", 1) for i in range(20)]
    P.save(tokens(spark, wide), f"file://{tmp_path}/set", dtype="uint32")
    assert sorted(r.tokens for r in P.load(spark, f"file://{tmp_path}/set").collect()) == [r[1] for r in wide]
    sizes = [os.path.getsize(f"{tmp_path}/set/{x}") for x in os.listdir(f"{tmp_path}/set") if x.endswith(".bin")]
    assert sum(sizes) == 4 * 60


def test_failed_write_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/set"
    P.save(tokens(spark, rows(20)), f"file://{folder}")
    before = sorted(os.listdir(folder))
    for bad in ([(1, [1, 2], "s", 1), (2, [70_000], "s", 1)], [(1, [-1], "s", 1)]):
        with pytest.raises(Exception, match="does not fit"):
            P.save(tokens(spark, bad), f"file://{folder}", mode="append")
        assert sorted(os.listdir(folder)) == before
    with pytest.raises(Exception, match="dtype"):
        P.save(tokens(spark, rows(2)), f"file://{folder}", dtype="uint8")


def test_append_and_overwrite(spark, tmp_path):
    folder = f"file://{tmp_path}/set"
    P.save(tokens(spark, rows(10)), folder)
    P.save(tokens(spark, [(5, [7, 8], "x", 1)]), folder, mode="append")
    back = P.load(spark, folder).orderBy("doc").collect()
    assert [r.doc for r in back] == list(range(14)) and back[-1].tokens == [7, 8]
    P.save(tokens(spark, [(5, [9], "x", 1)]), folder)
    assert [(r.doc, r.tokens) for r in P.load(spark, folder).collect()] == [(0, [9])]
    assert len([x for x in os.listdir(f"{tmp_path}/set") if x.endswith(".bin")]) <= 4


def test_a_document_reads_one_range(spark, tmp_path):
    data = sorted(rows())
    P.save(tokens(spark, data), f"file://{tmp_path}/set", parts=5)
    everything = P.load(spark, f"file://{tmp_path}/set")
    assert everything.rdd.getNumPartitions() > 1
    for i in (0, 57, 202):
        one = P.documents(spark, f"file://{tmp_path}/set", [i])
        assert one.rdd.getNumPartitions() == 1 and [r.tokens for r in one.collect()] == [data[i][1] or []]
    some = P.documents(spark, f"file://{tmp_path}/set", [3, 150, 999])
    assert sorted(r.doc for r in some.collect()) == [3, 150]
    assert P.documents(spark, f"file://{tmp_path}/set", []).count() == 0
    part = P.load(spark, f"file://{tmp_path}/set", **{"from": "11", "to": "15"})
    assert sorted(r.doc for r in part.collect()) == [11, 12, 13, 14] and part.rdd.getNumPartitions() == 1
    assert P.load(spark, f"file://{tmp_path}/set", **{"from": "500"}).count() == 0
    # A DataFrame that was filtered is whole again in the next query.
    assert everything.where("doc = 5").count() == 1 and everything.count() == len(data) and everything.where("doc >= 200").count() == len(data) - 200
    only = P.PackedReader(f"file://{tmp_path}/set", 100, only={57}).partitions()
    assert [(r.base + r.low, r.base + r.high) for r in only] == [(57, 58)]
    ranges = P.PackedReader(f"file://{tmp_path}/set", 100).partitions()
    assert len(ranges) > 20 and sum(r.high - r.low for r in ranges) == len(data)
    spread = spark.read.format("packed").option("rangeBytes", "100").load(f"file://{tmp_path}/set")
    assert sorted((r.doc, r.tokens) for r in spread.collect()) == [(i, r[1] or []) for i, r in enumerate(data)]


def test_files_without_a_manifest(spark, tmp_path):
    os.makedirs(f"{tmp_path}/own")
    for name, docs in (("a", [[1, 2], []]), ("b", [[3]])):
        flat = np.array([x for d in docs for x in d], "<u2")
        flat.tofile(f"{tmp_path}/own/{name}.bin")
        bounds = np.cumsum([0] + [len(d) for d in docs]).tolist()
        with open(f"{tmp_path}/own/{name}.idx", "w") as f:
            json.dump({"num_documents": len(docs), "total_tokens": len(flat), "dtype": "uint16", "document_boundaries": bounds}, f)
    found = P.load(spark, f"file://{tmp_path}/own")
    assert sorted((r.doc, r.tokens) for r in found.collect()) == [(0, [1, 2]), (1, []), (2, [3])]
    assert [r.tokens for r in P.documents(spark, f"file://{tmp_path}/own", [2]).collect()] == [[3]]
    with pytest.raises(Exception, match="no packed set"):
        P.load(spark, f"file://{tmp_path}/none").count()


def test_no_rows(spark, tmp_path):
    P.save(tokens(spark, []), f"file://{tmp_path}/set")
    assert P.load(spark, f"file://{tmp_path}/set").count() == 0


def test_batches_of_ids_are_small(tmp_path, monkeypatch):
    """A writer takes the ids of a batch, and a reader gives them, half a million at a time, but whole documents."""
    import pyarrow as pa
    from types import SimpleNamespace

    sizes = [200_000, 0, 300_000, 1, 900_000, 7] + [1000] * 1500
    ids = [np.full(n, i % 65_536, np.int32) for i, n in enumerate(sizes)]
    monkeypatch.setattr(P, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    writer, lots, own = P.PackedWriter(f"file://{tmp_path}/set", SimpleNamespace(names=["tokens"]), "uint16", True), [], P.PackedWriter._ids
    monkeypatch.setattr(P.PackedWriter, "_ids", lambda self, tokens: lots.append((len(tokens), len(tokens.flatten()))) or own(self, tokens))
    writer.commit([writer.write(iter([pa.RecordBatch.from_arrays([pa.array([*ids, None], pa.list_(pa.int32()))], ["tokens"])]))])
    reader = P.PackedReader(f"file://{tmp_path}/set", 1 << 30)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    for n, size in [*lots, *((len(b), len(b.column("tokens").flatten())) for b in batches)]:
        assert size <= 1 << 19 or n == 1
    back = [x for b in batches for x in b.column("tokens")]
    assert len(back) == len(ids) + 1 and len(back[-1]) == 0
    assert all(np.array_equal(x.values.to_numpy(), y) for x, y in zip(back, ids))
