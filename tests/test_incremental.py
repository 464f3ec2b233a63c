"""The stored near-duplicate index and streams over it, against one batch over everything."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import neardup
from corpuskit.operators.lshindex import LshIndex
from corpuskit.streaming import neardup as streaming

KIND = "doc_id long, text string, source string, n int"


def documents(n=60, seed=4):
    """Chains of near copies, exact copies, and texts of their own, with some missing."""
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    out = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=40)) if i % 4 == 0 or not out[-1] else out[-1]
        if i % 4 in (1, 2):
            parts = text.split()
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        out.append(text)
    rows = [(i, t, f"s{i % 3}", i) for i, t in enumerate(out)]
    return rows + [(200, None, "s0", 0), (201, "", "s1", 0), (202, None, None, 0), (203, out[0], None, 0), (204, "ab", "s0", 0), (205, "ab", "s1", 0), (206, out[8] + "!", "s2", 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def at_once(spark, rows, scope=None):
    return sorted(r.doc_id for r in neardup.near_duplicates(frame(spark, rows), "doc_id", scope).collect())


@pytest.mark.parametrize("scope", [None, "source"])
def test_batches_equal_one_batch(spark, tmp_path, scope):
    rows, folder = documents(), f"file://{tmp_path}/index"
    kept = []
    for number, (low, high) in enumerate(((0, 20), (20, 21), (21, 21), (21, len(rows)))):
        index = LshIndex(spark, folder, scope, buckets=4)
        kept += [r.doc_id for r in index.keep(number, frame(spark, rows[low:high])).collect()]
    want = at_once(spark, rows, scope)
    assert sorted(kept) == want and len(want) < len(rows) - 10
    names = [r.n for r in index.bands(spark).select("n").distinct().collect()]
    assert sorted(names) == want
    assert index.bands(spark).groupBy("k1", "k2").count().where("count > 1").isEmpty()


def test_a_batch_again_changes_nothing(spark, tmp_path):
    rows, index = documents(), LshIndex(spark, f"file://{tmp_path}/index", buckets=4)
    first = sorted(r.doc_id for r in index.add(1, frame(spark, rows[:30])).collect())
    second = sorted(r.doc_id for r in index.add(2, frame(spark, rows[30:])).collect())
    stored = index.bands(spark).count()
    assert sorted(r.doc_id for r in index.add(1, frame(spark, rows[:30])).collect()) == first
    assert sorted(r.doc_id for r in index.add(2, frame(spark, rows[30:])).collect()) == second
    assert index.bands(spark).count() == stored


def test_a_new_session_finds_the_index(spark, tmp_path):
    rows, folder = documents(), f"file://{tmp_path}/index"
    index = LshIndex(spark, folder, buckets=4)
    index.add(0, frame(spark, rows[:30]))
    spark.sql(f"DROP TABLE {index.name}")  # what the end of a session does; the files stay
    again = LshIndex(spark, folder, buckets=4)
    assert not again.bands(spark).isEmpty()
    hits = {r.doc_id: r.kept for r in again.hits(frame(spark, rows[:30])).collect()}
    assert all(kept <= i for i, kept in hits.items()) and set(hits.values()) <= set(at_once(spark, rows[:30]))
    with pytest.raises(ValueError):
        LshIndex(spark, folder, buckets=4, threshold=0.7)


def test_probe_shuffles_the_batch_alone(spark, tmp_path):
    index = LshIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.add(0, frame(spark, documents()))
    members = spark.createDataFrame([(1, 2, 3)], "k1 long, k2 long, n long").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = members.join(index.bands(spark, 1), ["k1", "k2"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.index("FileScan") - 400 :]
    assert plan.count("Exchange hashpartitioning(k1") == 1 and "Exchange" not in scan.split("FileScan")[0].split("Sort")[-1]


def write_files(spark, rows, folder, n):
    size = -(-len(rows) // n)
    for at in range(0, len(rows), size):
        frame(spark, rows[at : at + size]).coalesce(1).write.mode("append").parquet(folder)


def test_restarted_stream_equals_one_batch(spark, tmp_path):
    rows, base = documents(), f"file://{tmp_path}"
    folder, out, state = f"{base}/in", f"{base}/out", f"{base}/state"
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        write_files(spark, part, folder, 2)
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)
        query = streaming.near_dedup(stream, LshIndex(spark, f"{base}/index", buckets=4), out, state)
        query.awaitTermination()
        assert query.exception() is None
    found = spark.read.parquet(out)
    assert found.select("batch").distinct().count() == 4
    assert sorted(r.doc_id for r in found.collect()) == at_once(spark, rows)


def test_failed_micro_batch_runs_again(spark, tmp_path):
    """A micro-batch whose index was written but whose output was not: the restart gives the same rows."""
    rows, base = documents(), f"file://{tmp_path}"
    write_files(spark, rows, f"{base}/in", 3)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")

    class Broken(LshIndex):
        def keep(self, batch, docs, order="doc_id", text_col="text"):
            found = super().keep(batch, docs, order, text_col)
            if batch == 1:
                raise RuntimeError("lost")
            return found

    with pytest.raises(Exception, match="lost"):
        streaming.near_dedup(stream, Broken(spark, f"{base}/index", buckets=4), f"{base}/out", f"{base}/state").awaitTermination()
    streaming.near_dedup(stream, LshIndex(spark, f"{base}/index", buckets=4), f"{base}/out", f"{base}/state").awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{base}/out").collect()) == at_once(spark, rows)


def test_first_of_text_over_restarts(spark, tmp_path):
    rows, base = documents(), f"file://{tmp_path}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        write_files(spark, part, f"{base}/in", 2)
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        found = streaming.first_of_text(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        found.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = frame(spark, rows).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    assert sorted(r.doc_id for r in spark.read.parquet(f"{base}/out").collect()) == sorted(r.doc_id for r in want.collect())


def test_batches_are_dealt_to_all_tasks(spark):
    """A batch is a range of the ids, whatever their sign, and its rows lie in all partitions."""
    from corpuskit.plans.catalog_state import in_batches

    parts = in_batches(spark.range(-5, 3000, 1, 8).toDF("doc_id"))
    assert [sorted(r.doc_id for r in p.collect()) for p in parts] == [list(range(-5, 1000)), list(range(1000, 2000)), list(range(2000, 3000))]
    for p in parts:
        assert p.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism
    assert sum(p.count() for p in in_batches(spark.range(-4, 0).toDF("doc_id"))) == 4
