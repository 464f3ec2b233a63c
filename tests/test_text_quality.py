import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.functions import text as T
from corpuskit.operators import quality
from corpuskit.sources import readers
from pyspark.sql import functions as F

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def one(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(column).collect()]


def test_strip_is_pythons(spark):
    texts = [f"{s}a{s}b{s}" for s in SPACES] + ["", " ", "𠮷 "]
    assert one(spark, T.strip(F.col("t")), *texts) == [x.strip() for x in texts]


def test_cleaning_chain(spark):
    dirty = "<b>ＡＢＣ</b>　　http://x.y/z?q=1 見る\x00 3.14! (a)\n\n\n\nb…"
    got = one(spark, T.clean(F.col("t")), dirty, "", None, "  \n\t ")
    assert got == ["ABC 見る 3。14！ （a）\n\nb。。。", "", None, ""]
    assert one(spark, T.nfkc("t"), "ＡＢＣ１２３", "ｶﾞ") == ["ABC123", unicodedata.normalize("NFKC", "ｶﾞ")]


def test_ratios(spark):
    assert one(spark, T.script_ratio(F.col("t")), "𠮷野家abc", "", "abc") == [0.5, 0.0, 0.0]
    assert one(spark, T.has_run(F.col("t")), "a" * 10, "a" * 9, "ab" * 20) == [True, False, False]
    assert one(spark, T.answer_form(F.col("t")), " Ａ b　C ") == ["abc"]
    assert one(spark, T.subject_title(F.col("t")), "a_b", "", None) == ["a b", "一般知識", "一般知識"]


def test_repetition_borders():
    abc = "abcdefghijklmnop"
    assert [quality.repetition_of(abc[:n], 10) for n in (9, 10, 13, 14)] == [0.0, 1.0, 0.25, 0.2]
    assert quality.repetition_of(None, 10) is None


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60), st.integers(1, 5))
def test_repetition_by_counting(text, n):
    grams = [text[i : i + n] for i in range(len(text) - n + 1)]
    assert quality.repetition_of(text, n) == (max(map(grams.count, grams)) / len(grams) if grams else 0.0)


def test_reasons_in_order(spark):
    good = "日本語の文章がここにありますので読んでください。次の文もここに続いてとても長くなっていきます。最後の文です。"
    texts = ["短い", "a plain English text that is long enough to pass the first of the tests", "日本語" * 40, "\n".join(good[i : i + 8] for i in range(0, 54, 8)), good, None, ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = [r.reason for r in quality.with_reason(rows).orderBy("i").collect()]
    assert got == ["length", "cjk_ratio", "repetition", "mean_line_length", None, "length", "length"]
    assert {r.reason: r.n for r in quality.reason_counts(quality.with_reason(rows)).collect()} == {"length": 3, "cjk_ratio": 1, "repetition": 1, "mean_line_length": 1, "kept": 1}


def test_mean_line_counts_unstripped_lines(spark):
    assert one(spark, quality.mean_line(F.col("t")), " ab \n\n 　\ncd", "\n") == [pytest.approx(3.0), None]


def test_texts_are_cleaned_once(spark):
    """The filter's tests take the cleaned text and do not clean it again."""
    docs = spark.createDataFrame([(1, "<b>Plain text!</b>"), (2, "<b></b>"), (3, None), (4, "12345 a"), (5, "")], "doc_id long, text string").repartition(2)
    kept = quality.clean_filter(docs, 0.3, T.LATIN)
    assert kept._jdf.queryExecution().executedPlan().toString().count("translate(") == 1
    assert kept.columns == ["doc_id", "text"] and [tuple(r) for r in kept.collect()] == [(1, "Plain text！")]


def test_paragraph_edges_are_taken_off_once(spark):
    rows = [(1, "\n \nfirst one\n\nab\n \nsecond\nof two lines\n"), (2, None), (3, " " * 9 + "\n\n" + "x" * 5)]
    found = readers.paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), "text", 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_replace(") == 1
    want = [(1, 1, "first one"), (1, 3, "second\nof two lines"), (3, 1, "xxxxx")]
    assert sorted((r.doc_id, r.pos, r.paragraph) for r in found.collect()) == want
