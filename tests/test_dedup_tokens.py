import gc
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corpuskit.functions.lots import LOT_CHARS, arrow_lots
from corpuskit.operators import mixing, neardup, tokens
from corpuskit.plans import catalog, durable
from corpuskit.sources import packed, readers
from pyspark.sql import functions as F


def greedy(n, pairs):
    kept = []
    for b in range(n):
        if not any((a, b) in pairs for a in kept):
            kept.append(b)
    return kept


def test_bands():
    assert neardup.bands_for(0.8, 128) == (9, 13) and neardup.bands_for(0.8, 64) == (5, 11)


def test_first_wins_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    cases = [(3, {(0, 1), (1, 2)}), (3, {(0, 1), (0, 2)}), (40, {(i, i + 1) for i in range(39)}), (30, {tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)})]
    for n, pairs in cases:
        nodes = spark.createDataFrame([(i,) for i in range(n)], "doc_id long")
        members = spark.createDataFrame([(x, k, 0) for k, pair in enumerate(sorted(pairs)) for x in pair], "n long, k1 long, k2 long")
        assert sorted(r.doc_id for r in neardup.first_wins(nodes, members).collect()) == greedy(n, pairs)


def test_first_wins_on_hot_buckets(spark):
    rng = random.Random(6)
    rows = {(x, 0) for x in range(0, 1500, 3)} | {(x, rng.randrange(1, 400)) for x in range(1500) for _ in range(2)}
    by_bucket = {}
    for x, k in sorted(rows):
        by_bucket.setdefault(k, []).append(x)
    taken, want = set(), []
    for x in range(1500):
        mine = [k for k in by_bucket if (x, k) in rows]
        if not any(k in taken for k in mine):
            want.append(x)
            taken.update(mine)
    members = spark.createDataFrame([(x, k, k) for x, k in sorted(rows)], "n long, k1 long, k2 long")
    assert sorted(r.doc_id for r in neardup.first_wins(spark.range(1500).toDF("doc_id"), members).collect()) == want
    assert neardup.first_wins(spark.range(3).toDF("doc_id"), members.limit(0)).count() == 3


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Each node collides with the next one; prefixes of any size give the sequential rule."""
    n = 3000
    rows = [(x, k, 0) for k in range(n - 1) for x in (k, k + 1)] + [(x, 10_000 + x % 7, 1) for x in range(0, n, 11)] + [(n + 5, 99_999, 9)]
    by_node, taken, want = {}, set(), []
    for x, *k in rows:
        by_node.setdefault(x, []).append(tuple(k))
    for x in sorted(by_node):
        if not taken & set(by_node[x]):
            want.append(x)
            taken.update(by_node[x])
    members = spark.createDataFrame(rows, "n long, k1 long, k2 long").repartition(3)
    nodes = spark.createDataFrame([(x,) for x in by_node], "doc_id long")
    for rounds, prefix in ((1, 10**6), (2, 1000), (0, 1500)):
        monkeypatch.setattr(neardup, "ROUNDS", rounds)
        monkeypatch.setattr(neardup, "PREFIX", prefix)
        assert sorted(r.doc_id for r in neardup.first_wins(nodes, members).collect()) == want


def test_near_duplicates(spark):
    base = ["".join(random.Random(k).choices("あいうえおかきくけこ", k=200)) for k in range(4)]
    rows = [(i, t, "a") for i, t in enumerate(base)] + [(10, base[0], "a"), (11, base[1][:-1], "a"), (12, base[2], "b"), (13, "", "a"), (14, None, "a"), (15, "xy", "a"), (16, "xy", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in neardup.near_duplicates(docs).collect()) == [0, 1, 2, 3, 12, 15]
    assert sorted(r.doc_id for r in neardup.near_duplicates(docs, scope=None).collect()) == [0, 1, 2, 3, 15]
    stats = {r.source: r for r in neardup.dedup_stats(docs, neardup.near_duplicates(docs)).collect()}
    assert (stats["a"].total, stats["a"].duplicates, stats["a"].remaining) == (10, 3, 5)


def test_running_totals_and_numbers(spark):
    rows = spark.createDataFrame([(i, f"g{i % 2}", i * i) for i in range(50)], "k long, g string, v long").repartition(7)
    got = {r.k: r for r in durable.running(rows, ["k"], {"s": "v"}, ["g"]).collect()}
    assert all(got[k].s == sum(i * i for i in range(k % 2, k + 1, 2)) for k in range(50))
    assert [r.n for r in durable.numbered(rows, ["k"], "n").orderBy("k").collect()] == list(range(50))
    assert durable.numbered(rows.limit(0), ["k"], "n").count() == 0


def test_chunks_packing_and_shards(spark):
    rows = spark.createDataFrame([(1, "s", "abcde"), (2, "s", ""), (3, "s", "fghij"), (4, "t", "kl")], "doc_id long, source string, text string")
    located = tokens.offsets(tokens.tokenise(rows, tokens.char_encoder()))
    got = {(r.source, r.sample_id): "".join(map(chr, r.tokens)) for r in tokens.chunks(located, 4).collect()}
    assert got == {("s", 0): "abcd", ("s", 1): "efgh"}
    docs = spark.createDataFrame([([[1] * 5, [2] * 30, [3] * 3, [4] * 20],)], "d array<array<int>>")
    assert docs.select(tokens.greedy_pack(F.col("d"), 32, 0)).first()[0] == [1] * 5 + [0] + [3] * 3 + [0] + [4] * 20 + [0]


def test_shards_equal_the_sequential_rule(spark):
    rng = random.Random(4)
    data = [(i, "first", s) for i, s in enumerate([5, 5, 1, 20, 2, 3])] + [(i, "none", 0) for i in range(9)]
    data += [(i, f"g{k}", rng.choice([0, 0, 1, 3, 9, 10, 11, 40][: 4 + k])) for k in range(5) for i in range(150)] + [(i, None, 7) for i in range(40)]
    rng.shuffle(data)
    want = {}
    for name in {x[1] for x in data}:
        used = shard = 0
        for i, _, size in sorted((x for x in data if x[1] == name), key=lambda x: x[0]):
            if used + size > 10 and used > 0:
                used, shard = 0, shard + 1
            used += size
            want[name, i] = shard
    found = tokens.shard_numbers(spark.createDataFrame(data, "doc_id long, source string, size long").repartition(3), 10)
    got = found.collect()
    assert len(got) == len(data) and {(r.source, r.doc_id): r.shard for r in got} == want
    assert [want["first", i] for i in range(6)] == [0, 0, 1, 2, 3, 3]
    assert tokens.shard_numbers(found.drop("shard").limit(0), 10).count() == 0


def test_vocabulary_merge(spark):
    base = spark.createDataFrame([("a", 0), ("b", 1)], "piece string, id int")
    new = spark.createDataFrame([("<unk>", 0), ("b", 1), ("d", 2), ("c", 3), ("e", 4)], "piece string, id int")
    got = [(r.piece, r.id) for r in tokens.merge_vocabulary(base, new, 2, 8).orderBy("id").collect()]
    assert got == [("a", 0), ("b", 1), ("d", 2), ("c", 3), *[(f"<|pad_{i}|>", 4 + i) for i in range(4)]]


def test_packed_files(spark, tmp_path):
    data = [(i, [i, 70_000 + i] if i % 2 else [i]) for i in range(20)]
    manifest = packed.write_packed(spark.createDataFrame(data, "doc_id long, tokens array<int>"), f"file://{tmp_path}", parts=3)
    assert {r.dtype for r in manifest.collect()} == {"uint32"}
    assert sorted((r.doc_id, r.tokens) for r in packed.concatenated(spark, manifest).collect()) == data
    first = packed.PackedFile(manifest.orderBy("part").first().path)
    assert first.get_document(1).tolist() == [1, 70_001] and isinstance(first.get_document(0), np.ndarray)


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a", "id": 1}\n\n  \nnot json\n[1]\n{"id": 2}\n{"text": null}\n{"text": 5}\n', encoding="utf-8")
    assert [r.text for r in readers.read_jsonl(spark, str(tmp_path), "text STRING").collect()] == ["a", None, None, "5"]
    assert readers.raw_lines(spark, str(tmp_path)).count() == 8


def test_curriculum(spark):
    plan = [{"until_step": 10, "weights": {"a": 1.0}}, {"until_step": 20, "weights": {"a": 1.0, "b": 3.0}}]
    stages = mixing.stages(spark, plan, {"a": 1.0, "b": 1.0, "c": 1.0})
    steps = spark.createDataFrame([(9,), (10,), (99,)], "step long")
    got = {(r.step, r.source): r.weight for r in mixing.weights_at(steps, stages).collect()}
    assert got == {(9, "a"): 1.0, (10, "a"): 0.25, (10, "b"): 0.75, (99, "a"): 0.25, (99, "b"): 0.75}
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "doc_id long, source string")
    drawn = mixing.sample(docs, 200, stages).collect()
    assert len(drawn) == 200 and all(r.source == "a" for r in drawn if r.step < 10)
    per_epoch = [(r.source, r.epoch, r.doc_id) for r in drawn]
    assert len(per_epoch) == len(set(per_epoch))


def test_shingle_sets_come_in_small_runs(spark):
    batch = pd.Series([random.Random(k).randbytes(50_000).hex() for k in range(45)])
    found = list(neardup._sets(iter([batch, pd.Series([], dtype=object), pd.Series(["xyz"])])))
    assert [h for part in found for h in map(list, part)] == [list(neardup.shingle_hashes(x)) for x in [*batch, "xyz"]]
    assert max(sum(len(h) for h in part) for part in found) <= LOT_CHARS < sum(len(x) for x in batch)
    docs = spark.createDataFrame([(1, "abcdef"), (2, ""), (3, None), (4, "ab")], "doc_id long, text string")
    got = {r.doc_id: r.shingles for r in neardup.shingle_sets(docs, ["doc_id"]).collect()}
    assert got == {1: list(neardup.shingle_hashes("abcdef")), 4: list(neardup.shingle_hashes("ab"))}


def test_encoders_see_small_runs(spark):
    """An encoder gets about a million characters at a time, however many rows a batch has."""

    def encode(texts):
        assert sum(map(len, texts)) <= LOT_CHARS or len(texts) == 1
        return [[len(x)] for x in texts]

    docs = spark.range(60).selectExpr("id AS doc_id", "IF(id = 7, repeat('a', 3000000), repeat('b', 50000)) AS text").coalesce(1)
    want = {i: 3_000_000 if i == 7 else 50_000 for i in range(60)}
    assert {r.doc_id: r.tokens[0] for r in tokens.tokenise(docs, encode, max_len=None).select("doc_id", "tokens").collect()} == want
    assert tokens.counted(docs, encode, max_len=None).where("n_tokens = 1").count() == 60


def test_only_a_run_of_a_batch_is_python_strings(spark):
    """A worker makes strings of about a million characters at a time, not of all texts that an Arrow batch brings."""

    def held(texts):
        lists = [x for x in gc.get_objects() if type(x) is list and x and type(x[0]) is str and len(x[0]) == 500_000]
        return [[max(map(len, lists), default=0)] if x else [] for x in texts]

    docs = spark.range(61).selectExpr("id AS doc_id", "IF(id = 60, 'end', IF(id = 5, NULL, IF(id = 6, '', repeat('a', 500000)))) AS text").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = {r.doc_id: r.tokens for r in tokens.tokenise(docs, held, max_len=None, drop_empty=False).select("doc_id", "tokens").collect()}
        sizes = [r.n_tokens for r in tokens.counted(docs, held, max_len=None).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 61 and found[5] == found[6] == [] and sizes == [1] * 59
    assert max(x for ids in found.values() for x in ids) <= 4


def test_runs_of_arrow_batches():
    batches = [pa.array(["ab", None, "", "cdé", "x" * 9, "", "y"]), pa.array([], pa.string()), pa.array(["z", None], pa.large_string())]
    assert list(arrow_lots(iter(batches), 5)) == [["ab", "", "", "cdé"], ["x" * 9], ["", "y"], ["z", ""]]


def _near_copies(spark, folder, copies, chars):
    """Families of near copies, one of each copied exactly, next to short and unlike texts."""
    rng, rows = random.Random(5), []
    for family in range(2):
        base = "".join(rng.choices("abcdefgh ", k=chars))
        for k in range(copies):
            cuts = sorted(rng.sample(range(chars), 1 + k % 3 * 2))
            rows.append("".join(base[x:y] + rng.choice("xyz") for x, y in zip([0, *cuts], [*cuts, chars])))
        rows.append(rows[-1])
    rows += ["", None, "ab", "abc", "ab", *("".join(rng.choices("ijklmn", k=200)) for _ in range(20))]
    rng.shuffle(rows)
    spark.createDataFrame([(7 * i, x) for i, x in enumerate(rows)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return {7 * i: set(neardup.shingle_hashes(x).tolist()) for i, x in enumerate(rows) if x}


@pytest.mark.parametrize(("nodes", "columns", "chars", "out"), [(1024, 2048, 1 << 21, 1 << 16), (3, 7, 1 << 21, 64), (1024, 50, 900, 5)])
def test_similarities_are_those_of_all_pairs(spark, tmp_path, monkeypatch, nodes, columns, chars, out):
    """Each candidate pair once, with the similarity of its sets, whatever the chunks, the matrices and the batches."""
    for name, value in (("CHUNK_NODES", nodes), ("COLUMNS", columns), ("CHUNK_CHARS", chars), ("OUT", out)):
        monkeypatch.setattr(neardup, name, value)
    sets = _near_copies(spark, tmp_path, 20, 400)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    pairs = [tuple(r) for r in neardup.collisions(neardup.signatures(docs, ["doc_id"])).collect()]
    members = neardup.memberships(neardup.signatures(docs, ["doc_id"]))[1]
    got = [tuple(r) for r in neardup.similarities(docs, members).collect()]
    assert len(pairs) > 200
    assert sorted(got) == sorted((a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in pairs)


def test_batches_cut_units_anywhere():
    """A unit's rows may come in several batches, and a batch may hold several units."""
    keys = [(1, 1, 0, 0)] * 5 + [(1, 2, 0, 0)] + [(2, 2, 0, 0)] * 3 + [(2, 2, 0, 1)] * 4
    table = pa.table({c: pa.array([k[p] for k in keys], pa.int64()) for p, c in enumerate(("g1", "g2", "i", "j"))})
    for size in (1, 2, 3, 5, 100):
        found = [tuple(x.slice(0, 1).to_pylist()[0].values()) + (len(x),) for x in neardup._units(iter([pa.RecordBatch.from_pylist([], table.schema), *table.to_batches(size)]))]
        assert found == [(1, 1, 0, 0, 5), (1, 2, 0, 0, 1), (2, 2, 0, 0, 3), (2, 2, 0, 1, 4)]


def test_jaccard_pairs_shuffle_no_text_for_each_pair(spark, tmp_path):
    """A large family of near copies costs its texts a few times, not its pairs; its table is taken as too large to broadcast."""
    sets = _near_copies(spark, tmp_path, 90, 3000)
    context, limit = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    context.setJobGroup("jaccard_pairs", "")
    try:
        rows = catalog.QUERIES["p_jaccard_pairs"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("jaccard_pairs") for s in tracker.getJobInfo(j).stageIds}
    shuffled = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert len(rows) > 3000
    assert all(abs(r.jaccard - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) < 1e-6 for r in rows)
    assert 0 < shuffled < 10_000_000
