import os
import re
import subprocess
import sys
import unicodedata
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from corpuskit.operators import neardup
from corpuskit.plans import catalog, catalog_eval, catalog_state  # noqa: F401

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_oracle(spark):
    assert catalog.QUERIES["k_sentencepiece"](spark, SF).count() > 0


def plain_clean(text):
    text = re.sub(r"<[^>]+>", "", unicodedata.normalize("NFKC", text))
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", re.sub(r"https?://\S+|www\.\S+", "", text))
    text = text.translate(str.maketrans("!?,.:;()", "！？、。：；（）"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def plain_passes(text):
    lines = [x for x in text.split("\n") if x.strip()]
    grams = Counter(text[i : i + 10] for i in range(len(text) - 9))
    if not 50 <= len(text) <= 500_000 or max(grams.values(), default=0) > 0.2 * max(1, sum(grams.values())):
        return False
    return bool(lines) and 10 <= sum(map(len, lines)) / len(lines) <= 10_000


def test_pipeline_against_a_plain_one(spark):
    """All stages of the corpus build, one document after another."""
    docs = [(r.doc_id, r.source, plain_clean(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    bands, rows = neardup.bands_for()
    want, seen = [], set()
    for i, source, text in docs:
        if not text or len(re.findall("[A-Za-z\u00c0-\u024f]", text)) / len(text) < 0.3:
            continue
        signature = neardup.minhash(text)
        keys = {(source, b, tuple(signature[b * rows : (b + 1) * rows].tolist())) for b in range(bands)}
        if not keys & seen:
            seen |= keys
            if plain_passes(text):
                want.append((i, source, min(4096, len(text.encode()))))
    assert sorted(map(tuple, catalog.QUERIES["d_pipeline"](spark, SF).collect())) == want and 0 < len(want) < len(docs)


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", __spark_entry__.queries()["f_reason"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
