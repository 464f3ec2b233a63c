"""Ingest with a ledger: repeated, killed and restarted batches add nothing twice."""

import pytest

from corpuskit.sources import readers
from corpuskit.streaming import ingest


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(t, source) for t in texts], "text string, source string").repartition(3)


def texts(spark, store):
    return sorted(r.text for r in store.documents(spark).collect())


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_batches(spark, tmp_path, bits):
    """A filter of 64 bits is full at once, and all is looked up."""
    store = ingest.Ingest(f"file://{tmp_path}/own", bits)
    assert store.documents(spark).count() == 0
    assert store.add(0, frame(spark, ["a", " a ", "b", "", "  ", None] + [f"t{i}" for i in range(50)])) == 52
    assert store.add(1, frame(spark, ["b", "c", "c\n", *[f"t{i}" for i in range(40, 60)]])) == 11
    assert store.add(2, frame(spark, [])) == 0
    want = sorted(["a", "b", "c", *[f"t{i}" for i in range(60)]])
    assert texts(spark, store) == want
    assert store.add(1, frame(spark, ["something else"])) == 11  # done already
    assert texts(spark, ingest.Ingest(f"file://{tmp_path}/own", bits)) == want
    assert {r.batch: r.documents for r in store.ledger(spark).collect()} == {0: 52, 1: 11, 2: 0}


def test_sources_of_repeated_texts(spark, tmp_path):
    store = ingest.Ingest(f"file://{tmp_path}/own", 1 << 10)
    rows = frame(spark, ["x", "y"], "b").unionByName(frame(spark, ["x"], "a")).unionByName(frame(spark, ["z"], None))
    assert store.add(0, rows) == 3
    assert {r.text: r.source for r in store.documents(spark).collect()} == {"x": "a", "y": "b", "z": None}


def test_killed_batch(spark, tmp_path, monkeypatch):
    """A batch that wrote its texts and keys but not the ledger counts for nothing until it runs again."""
    store = ingest.Ingest(f"file://{tmp_path}/own", 1 << 10)
    store.add(0, frame(spark, ["a", "b"]))
    real = store._bits_of
    monkeypatch.setattr(store, "_bits_of", lambda keys: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.add(1, frame(spark, ["b", "c", "d"]))
    assert texts(spark, store) == ["a", "b"]
    monkeypatch.setattr(store, "_bits_of", real)
    assert store.add(1, frame(spark, ["b", "c", "d"])) == 2
    assert store.add(2, frame(spark, ["c", "e"])) == 1
    assert texts(spark, store) == ["a", "b", "c", "d", "e"]


def test_stream_of_a_registered_source(spark, tmp_path):
    registry = {"own": readers.SourceSpec("corpus", text_field="body")}
    store = ingest.Ingest(f"file://{tmp_path}/own", 1 << 12)
    for lot in (range(0, 10), range(5, 15), range(0, 15)):
        spark.createDataFrame([(f"text {i}", i) for i in lot], "body string, n int").coalesce(2).write.mode("append").parquet(f"{tmp_path}/corpus")
        rows = ingest.source_stream(spark, "own", str(tmp_path), registry, files=1)
        store.stream(rows, f"file://{tmp_path}/state").awaitTermination()
    assert texts(spark, store) == sorted(f"text {i}" for i in range(15))
    assert {r.source for r in store.documents(spark).collect()} == {"own"}
    assert store.ledger(spark).count() >= 3
    with pytest.raises(ValueError):
        ingest.Ingest("x", 100)
