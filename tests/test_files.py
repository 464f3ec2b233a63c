"""Folders of JSONL files: an output for each input, statistics from the pass that writes it."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import quality
from corpuskit.plans import files


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write("".join(x + "\n" for x in lines))


def text(seed, n=80):
    return " ".join(random.Random(seed).choices("river stone maple engine copper window".split(), k=n))


def line(x, **more):
    return json.dumps({"text": x, **more})


LIMITS = quality.Limits(min_ratio=0.0)


def inputs(folder):
    write(folder, "a.jsonl", [line(text(i), n=i) for i in range(5)] + ["", "  ", "not json", line("<b></b>"), line(None), json.dumps({"other": 1}), "[1]"])
    write(folder, "b+ b.jsonl", [line("x" * 300), line("short"), line("short too"), line(text(9))])
    write(folder, "c.jsonl", ["", "nothing"])
    write(folder, "d=é.jsonl", [line("short")])


def rows(found):
    return {r.file: (r.total, r.kept, r.filtered, dict(r.reasons)) for r in found.collect()}


def texts(spark, out, file=None):
    found = files.output(spark, out)
    return sorted(r.text for r in found.collect() if file in (None, r.file))


def jobs(spark, work):
    """Jobs that a piece of work runs."""
    context, group = spark.sparkContext, f"g{random.random()}"
    context.setJobGroup(group, "")
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group))


def test_clean_and_filter(spark, tmp_path):
    folder, base = str(tmp_path / "in"), f"file://{tmp_path}"
    inputs(folder)
    clean = files.clean_files(spark, folder, f"{base}/clean", 0.3, T.LATIN)
    assert rows(clean) == {"a.jsonl": (12, 5, 7, {}), "b+ b.jsonl": (4, 4, 0, {}), "c.jsonl": (2, 0, 2, {}), "d=é.jsonl": (1, 1, 0, {})}
    assert {r.file: r.filter_rate for r in clean.collect()}["a.jsonl"] == pytest.approx(7 / 12)
    one = files.summary(clean).first()
    assert (one.files, one.total, one.kept, one.filtered) == (4, 19, 10, 9)
    assert texts(spark, f"{base}/clean", "a.jsonl") == sorted(text(i) for i in range(5))
    found = files.filter_files(spark, folder, f"{base}/filtered", LIMITS)
    assert rows(found)["b+ b.jsonl"] == (4, 1, 3, {"length": 2, "repetition": 1})
    assert rows(found)["a.jsonl"] == (12, 5, 7, {"length": 3})  # null, missing and short texts; other lines have no row
    assert rows(found)["d=é.jsonl"] == (1, 0, 1, {"length": 1})
    assert sorted(os.listdir(tmp_path / "filtered"))[-2:] == ["file=a.jsonl", "file=b+ b.jsonl"]


def test_one_job_a_stage(spark, tmp_path):
    folder, base = str(tmp_path / "in"), f"file://{tmp_path}"
    inputs(folder)
    assert jobs(spark, lambda: files.filter_files(spark, folder, f"{base}/out", LIMITS)) == 1


def test_a_changed_input_rewrites_its_own_output(spark, tmp_path):
    folder, base = str(tmp_path / "in"), f"file://{tmp_path}"
    inputs(folder)
    files.filter_files(spark, folder, f"{base}/out", LIMITS)
    other = {x: os.stat(f"{tmp_path}/out/file=a.jsonl/{x}").st_mtime_ns for x in os.listdir(tmp_path / "out/file=a.jsonl")}
    write(folder, "b+ b.jsonl", [line(text(20)), line(text(21))])
    assert rows(files.filter_files(spark, folder, f"{base}/out", LIMITS, only=["b+ b.jsonl"])) == {"b+ b.jsonl": (2, 2, 0, {})}
    assert texts(spark, f"{base}/out", "b+ b.jsonl") == sorted([text(20), text(21)])
    assert other == {x: os.stat(f"{tmp_path}/out/file=a.jsonl/{x}").st_mtime_ns for x in os.listdir(tmp_path / "out/file=a.jsonl")}
    write(folder, "b+ b.jsonl", [line("short")])
    files.filter_files(spark, folder, f"{base}/out", LIMITS, only=["b+ b.jsonl"])
    assert texts(spark, f"{base}/out", "b+ b.jsonl") == [] and len(texts(spark, f"{base}/out")) == 5
    with pytest.raises(FileNotFoundError):
        files.filter_files(spark, folder, f"{base}/out", LIMITS, only=["none.jsonl"])
    write(f"{folder}/more", "a.jsonl", [line("x")])
    with pytest.raises(ValueError, match="two inputs"):
        files.filter_files(spark, f"{folder}/{{,more/}}*.jsonl", f"{base}/out", LIMITS)


def test_groups_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES", 3)
    folder, base = str(tmp_path / "in"), f"file://{tmp_path}"
    for i in range(8):
        write(folder, f"f{i}.jsonl", [line(text(i * 10 + k)) for k in range(i)] + [line("s")] * (i % 3))
    found = rows(files.filter_files(spark, folder, f"{base}/out", LIMITS))
    assert found == {f"f{i}.jsonl": (i + i % 3, i, i % 3, {"length": i % 3} if i % 3 else {}) for i in range(8)}
    assert len(texts(spark, f"{base}/out")) == 28
    counts = files.output(spark, f"{base}/out").groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.file: r.n for r in counts} == {f"f{i}.jsonl": i for i in range(1, 8)}


def test_many_files_are_counted_exactly(spark, tmp_path):
    """More files than a histogram would tell apart by chance, in rows that come in any order."""
    folder = str(tmp_path / "in")
    for i in range(150):
        write(folder, f"{i:03d}.jsonl", [line("s")] * (1 + i % 7))
    found = rows(files.filter_files(spark, folder, f"file://{tmp_path}/out", LIMITS))
    assert {k: v[0] for k, v in found.items()} == {f"{i:03d}.jsonl": 1 + i % 7 for i in range(150)}
    assert all(v[1] == 0 and v[3] == {"length": v[0]} for v in found.values())
