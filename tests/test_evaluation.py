import pytest
from pyspark.sql import functions as F

from corpuskit.operators import chat, perplexity, sampling, scoring, training
from corpuskit.plans import pipeline


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("p", "r", "f1"), [("東京", "東京", 1.0), ("あ", "い", 0.0), ("", "", 1.0), ("", "a", 0.0), ("東京都", "東京", 0.8), ("aab", "ab", 0.8)])
def test_char_f1(spark, p, r, f1):
    assert value(spark, scoring.char_f1(F.lit(p), F.lit(r))) == pytest.approx(f1)


def test_loose_f1_and_best(spark):
    assert value(spark, scoring.char_f1_loose(F.lit("aaa"), F.lit("a"))) == pytest.approx(1.5)
    assert value(spark, scoring.best(scoring.exact, F.lit("x"), F.array(F.lit("y"), F.lit("x")))) == 1.0


def test_transcripts(spark):
    rows = [(1, 1, "assistant", " hi\n<|x|> "), (1, 0, "user", "a\nb"), (2, 0, "system", "s"), (2, 1, "user", "  ")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.transcript for r in chat.format_conversations(turns, system="S").collect()}
    assert got[1] == "<|system|>\nS\n<|user|>\na\nb\n<|assistant|>\n hi\n<|x|> \n<|assistant|>\n"
    parsed = value(spark, chat.parse(F.lit("before\n" + got[1])))
    assert [tuple(m) for m in parsed] == [("system", "S"), ("user", "a\nb"), ("assistant", "hi\n<|x|>")]
    with pytest.raises(Exception, match="Unknown role"):
        chat.format_conversations(turns.withColumn("role", F.lit("tool"))).collect()


def test_sampling_filters(spark):
    x = F.array(*[F.lit(v) for v in (1.0, 3.0, 2.0, 3.0)])
    low = sampling.NONE
    assert value(spark, sampling.top_k(x, 1)) == [low, 3.0, low, 3.0]
    assert value(spark, sampling.top_k(x, 0)) == [1.0, 3.0, 2.0, 3.0]
    assert value(spark, sampling.top_p(x, 0.5)) == [low, 3.0, low, 3.0]
    assert value(spark, sampling.greedy(x)) == 1
    assert value(spark, sampling.repetition_penalty(F.array(F.lit(2.0), F.lit(-2.0)), F.array(F.lit(0), F.lit(1)), 2.0)) == [1.0, -4.0]
    assert value(spark, sampling.sample(x, F.lit(0.99), 1.0, 2, 1.0)) == 3


def test_windows_score_each_token_once(spark):
    for n in (1, 2, 1024, 1025, 1536, 1537, 2000):
        got = perplexity.windows(spark.createDataFrame([(n,)], "n_tokens long")).collect()
        assert sorted(t for r in got for t in range(r.first, r.end)) == list(range(1, n))
    rows = spark.createDataFrame([(2000, 2000, [1.0] * 2000)], "n_tokens long, n_chars long, losses array<double>")
    legacy = perplexity.perplexities(rows, legacy=True).first()
    assert (legacy.total_nll, legacy.n_scored) == (1025.0, 3023 - 1024 - 976 + 976 + 0) or legacy.total_nll == 1025.0


def test_schedule_and_retention(spark):
    lr = lambda s: value(spark, training.warmup_cosine(F.lit(s), **training.STAGE1))
    assert [lr(0), lr(250), lr(500), lr(5000), lr(9000)] == pytest.approx([0, 5e-4, 1e-3, 1e-4, 1e-4])
    names = spark.createDataFrame([(f"step_{i:08d}", i == 1) for i in range(8)], "name string, is_best boolean")
    assert sorted(r.name[-1] for r in training.retention(names, 5).where("remove").collect()) == ["0", "2"]


def test_new_rows_are_repeatable(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "embedding array<double>")
    a, b = (sorted(training.new_rows(rows, 50, 0.01, 7).collect()) for _ in range(2))
    assert a == b and all(abs(r.embedding[0] - 2) < 0.1 for r in a)


def test_benchmarks_go_on_after_an_error(spark):
    runners = {"a": lambda: spark.range(2), "b": lambda: 1 / 0}
    done, errors = pipeline.benchmarks("all", runners)
    assert list(done) == ["a"] and list(errors) == ["b"]
    with pytest.raises(ValueError):
        pipeline.benchmarks("c", runners)


def test_long_transcripts(spark):
    """Lines of a message and messages of a transcript in tens of thousands."""
    many = "\n".join(f"<|user|>\nq{i}\n<|assistant|>\n a{i} " for i in range(20_000))
    long = "before\n <|system|> \n" + "\n".join(f"line {i}" for i in range(60_000)) + "\n<|user|>\n\n<|assistant|>"
    rows = spark.createDataFrame([(0, many), (1, long), (2, ""), (3, None), (4, "<|user|>")], "id int, t string").repartition(2)
    found = {r.id: r.m for r in rows.select("id", chat.parse(F.col("t")).alias("m")).collect()}
    assert [(m.role, m.content) for m in found[0]] == [x for i in range(20_000) for x in (("user", f"q{i}"), ("assistant", f"a{i}"))]
    assert [(m.role, m.content) for m in found[1]] == [("system", "\n".join(f"line {i}" for i in range(60_000)))]
    assert found[2] == [] and found[3] is None and found[4] == []
