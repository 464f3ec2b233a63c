"""Drivers and sources from files to results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import mixing, quality, tokens, training
from corpuskit.plans import durable, pipeline
from corpuskit.sources import packed, readers
from corpuskit.streaming import clean as streaming

WORDS = "日本語 の 文章 を 処理 する 道具 です 今日 は 天気 が 良い ので 公園 へ 行き ました 犬 と 猫 が 好き な 人 も 多い 山 川 海 空 雪 花 本 紙 魚 鳥".split()


def sentence(seed, n=40):
    rng = random.Random(seed)
    return "".join(rng.choices(WORDS, k=n)) + "。"


def test_files_to_a_packed_set(spark, tmp_path):
    """Cleaning counts every raw line; near copies, short, Latin and repeated texts go, per file."""
    lines = [sentence(i) for i in range(12)]
    bad = ["not json", "", json.dumps({"text": "Latin letters alone are too few. " * 3}), json.dumps({"text": "<b>"}), json.dumps({"other": 1})]
    copies = [json.dumps({"text": x}, ensure_ascii=False) for x in lines[:3]]
    (tmp_path / "in").mkdir()
    for name, lot in (("a.jsonl", lines[:8]), ("b.jsonl", lines[8:])):
        rows = [json.dumps({"text": x, "n": 1}, ensure_ascii=False) for x in lot]
        rows += bad + copies if name == "a.jsonl" else [json.dumps({"text": "短い"}), json.dumps({"text": "あいう" * 100})]
        (tmp_path / "in" / name).write_text("\n".join(rows) + "\n", encoding="utf-8")
    found = pipeline.run_files(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", tokens.char_encoder())
    clean = {r.source: (r.total, r.kept) for r in found["clean"].collect()}
    assert clean == {"a.jsonl": (16, 11), "b.jsonl": (6, 6)}
    dedup = {r.source: (r.total, r.duplicates, r.remaining) for r in found["dedup"].collect()}
    assert dedup == {"a.jsonl": (11, 3, 8), "b.jsonl": (6, 0, 6)}
    assert {(r.source, r.total, r.kept) for r in found["filter"].collect()} == {("a.jsonl", 8, 8), ("b.jsonl", 6, 4), (None, 14, 12)}
    assert {r.reason: r.n for r in found["reasons"].collect()} == {"kept": 12, "length": 1, "repetition": 1}
    back = packed.concatenated(spark, found["manifest"]).collect()
    assert sorted("".join(map(chr, r.tokens)) for r in back) == sorted(lines)
    assert {r.source: r.documents for r in packed.distribution(spark, found["manifest"]).collect()} == {"a.jsonl": 8, "b.jsonl": 4}
    assert {(r.source, r.documents) for r in found["prepare"].collect()} == {("a.jsonl", 8), ("b.jsonl", 4), (None, 12)}


def test_download_resumes(spark, tmp_path):
    for name, n in (("one", 6), ("two", 3)):
        spark.createDataFrame([(f" text {name} {i % 5} ",) for i in range(n)] + [("  ",), (None,)], "text string").write.parquet(f"{tmp_path}/{name}")
    registry = {"one": readers.SourceSpec("one"), "gone": readers.SourceSpec("gone"), "two": readers.SourceSpec("two")}
    run = lambda **k: {r.source: r.documents for r in readers.download(spark, root=str(tmp_path), out=f"{tmp_path}/out", registry=registry, **k).collect()}
    assert run(dataset="two", max_docs=0) == {"two": 1}
    assert run(dataset="two", max_docs=2) == {"two": 2}
    first = run(dataset="all")
    assert first == {"one": 6, "two": 3}
    assert run(dataset="all") == first
    texts = {r.text for r in readers.read_jsonl(spark, f"{tmp_path}/out/two").collect()}
    assert texts == {"text two 0", "text two 1", "text two 2"}
    with pytest.raises(Exception):  # noqa: B017
        run(dataset="gone")


def test_text_sources_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"line {9 - i}") for i in range(9, -1, -1)], "doc_id long, text string").repartition(3)
    readers.write_text(docs, f"{tmp_path}/text", max_docs=3)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/text").collect()) == ["line 7", "line 8", "line 9"]
    for name in ("b.txt", "x/a.tsv", "x/y/c.csv", "d.jsonl"):
        (tmp_path / "tok" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tok" / name).write_text(f"{name}\n", encoding="utf-8")
    assert sorted(r.text for r in readers.tokenizer_inputs(spark, f"{tmp_path}/tok").collect()) == ["b.txt", "x/a.tsv", "x/y/c.csv"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.tokenizer_inputs(spark, f"{tmp_path}/none")
    sized = readers.total_bytes(spark, f"{tmp_path}/tok").first()
    assert (sized["files"], sized["bytes"]) == (4, sum(len(n) + 1 for n in ("b.txt", "x/a.tsv", "x/y/c.csv", "d.jsonl")))
    (tmp_path / "broken.parquet").write_bytes(b"no parquet at all")
    docs.write.parquet(f"{tmp_path}/good")
    chosen = readers.first_of(spark, [("parquet", f"{tmp_path}/missing"), ("parquet", f"{tmp_path}/broken.parquet"), ("parquet", f"{tmp_path}/good")])
    assert chosen.count() == 10
    with pytest.raises(FileNotFoundError):
        readers.first_of(spark, [("parquet", f"{tmp_path}/missing")])
    (tmp_path / "c.json").write_text('{"a": {"b": [1, 2]}}', encoding="utf-8")
    assert readers.load_config(f"{tmp_path}/c.json") == {"a": {"b": [1, 2]}}
    readers.write_results(docs, f"{tmp_path}/results")
    assert spark.read.json(f"{tmp_path}/results").count() == 10


def test_synthetic_corpus_and_exact_copies(spark):
    rows = readers.synthetic(spark, ["a", "b", "c"], 2)
    assert [(r.id, r.text) for r in rows.collect()] == [("doc_0", "a"), ("doc_1", "b"), ("doc_2", "c"), ("dup_0", "a"), ("dup_1", "b")]


def test_bpe_training_round_trip(spark, tmp_path):
    """A small vocabulary of 8 sentences, 50 times each; only the test trains it."""
    pytest.importorskip("sentencepiece")
    lines = [sentence(i, 12) for i in range(8)]
    rows = spark.createDataFrame([(x,) for x in lines * 50] + [("",), (None,)], "text string")
    path = tokens.train_bpe(rows, f"{tmp_path}/m", vocab=400)
    ids = tokens.tokenise(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string"), tokens.sentencepiece_encoder(path)).collect()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [model.pad_id(), model.unk_id(), model.bos_id(), model.eos_id()] == [0, 1, 2, 3]
    assert {r.doc_id: model.decode(list(r.tokens)) for r in ids} == dict(enumerate(lines))


def test_mixed_dataset_and_loader(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    stages = mixing.stages(spark, [{"until_step": 30, "weights": {"a": 1.0}}, {"until_step": 99, "weights": {"a": 1.0, "b": 1.0}}], {"a": 1.0, "b": 1.0})
    manifest = pipeline.mixed(docs, tokens.char_encoder(), stages, out=f"file://{tmp_path}/m", n=200)
    sources = {r.source: r.documents for r in packed.distribution(spark, manifest).collect()}
    drawn = mixing.sample(docs, 200, stages)
    assert sources == {r.source: r["count"] for r in drawn.groupBy("source").count().collect()} and sum(sources.values()) == 200
    back = ["".join(map(chr, r.tokens)) for r in packed.concatenated(spark, manifest).orderBy("doc_id").collect()]
    assert back == [f"text {r.doc_id}" for r in drawn.orderBy("i").collect()]
    batches = pipeline.mixed(docs, tokens.char_encoder(), stages, mode="dataloader", batch=4, steps=5, length=8).collect()
    assert len(batches) == 20 and {r.step for r in batches} == set(range(5)) and all(len(r.input_ids) == 8 and r.source == "a" for r in batches)
    for mode, out in (("dataset", None), ("other", "x")):
        with pytest.raises(ValueError):
            pipeline.mixed(docs, tokens.char_encoder(), stages, mode=mode, out=out)


def test_suites_pass_unknown_tasks_over(spark):
    done, errors = pipeline.benchmarks("a,c", {"a": lambda: spark.range(2)}, strict=False)
    assert list(done) == ["a"] and errors == {}


def test_moving_means_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK", 16)
    rng = random.Random(1)
    data = [(run, s, rng.random()) for run in ("x", "y", None) for s in range(1, 100)]
    rows = spark.createDataFrame(data, "run string, step long, loss double").repartition(5)
    got = {(r.run, r.step): (r.trailing_mean, r.best_so_far) for r in training.moving(rows, "run").collect()}
    for run in ("x", "y", None):
        own = [v for r, _, v in data if r == run]
        for i in range(99):
            last = own[max(0, i - 9) : i + 1]
            assert got[run, i + 1] == (pytest.approx(sum(last) / len(last)), min(own[: i + 1]))
    assert len(got) == len(data) and training.moving(rows.limit(0), "run").count() == 0


def test_records(spark):
    row = training.model_config(spark.createDataFrame([('{"dim": 64, "other": 1, "qk_rope_head_dim": 8}',)], "config string")).first()
    assert (row.dim, row.qk_head_dim, row.head_dim, row.n_layers, row.dtype) == (64, 136, 128, 61, "bfloat16")
    results = spark.createDataFrame([(True, False, 1.0), (False, False, 2.0), (False, True, 0.0), (True, False, 0.5)], "passed boolean, skipped boolean, elapsed double")
    assert {r.status: (r.n, r.elapsed) for r in training.result_totals(results).collect()} == {"PASS": (2, 1.5), "FAIL": (1, 2.0), "SKIP": (1, 0.0)}
    calls = spark.createDataFrame([(3, 4), (5, None)], "prompt_tokens long, completion_tokens long")
    assert tuple(training.usage(calls).first()) == (8, 4, 12)


def test_exact_dedup_of_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:02:00"), (None, "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "text string, ts string").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string, ts timestamp").json(f"{tmp_path}/in")
    streaming.write(streaming.exact_dedup(stream, "ts"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(str(r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["None", "a", "b"]


def test_shared_folder_is_asked_for(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        durable.shared_dir(Session())


def test_quality_of_kana(spark):
    """The default script test keeps Japanese texts and names Latin ones."""
    rows = spark.createDataFrame([(1, sentence(1)), (2, "Latin letters alone. " * 9), (3, sentence(2) + " with a few words")], "doc_id long, text string")
    assert {r.doc_id: r.reason for r in quality.with_reason(rows).collect()} == {1: None, 2: "cjk_ratio", 3: None}
    assert rows.select(T.script_ratio(F.lit("ＡＢＣ日本")).alias("x")).first().x == 0.4
