"""The pipeline against its stages' rules, and the registered queries."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from corpuskit.llm import bpe, simhash

SF = "/root/testdata/sf0.001"


def test_registered():
    queries = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in queries) == 1
    assert "pipeline" in queries and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    bad = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "123 !!", "en", "src1", 7), (10**6 + 2, docs.first().text, "fr", "src1", 1)], docs.schema)
    docs = docs.unionByName(bad)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert seen["language_id"].count() == 201 and seen["line_dedup"].count() == 201
    kept = seen["simhash_dedup"].collect()
    assert len({r.doc_id for r in kept}) == len(kept) and 10**6 + 2 not in {r.doc_id for r in kept}
    prints = [simhash.fingerprint(r.text) for r in kept]
    assert all(bin(a ^ b).count("1") > 3 for i, a in enumerate(prints) for b in prints[:i])
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    want = sorted((r.doc_id, len(encoding.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in seen["mix_sources"].collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in seen["byte_bpe"].collect()) == want


def test_stages_on_odd_tables(spark):
    """No rows at all, and rows that repeat or lack everything but a text, through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0
    text = docs.first().text
    odd = spark.createDataFrame([(None, text, None, None, None)] * 3 + [(7, "the same words again and again", "en", "a", 1)] * 4 + [(8, "", "en", None, 0), (9, None, None, "b", None)], docs.schema)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, SF)
        sizes.append(odd.count())
        if name == "simhash_dedup":
            assert sorted(str(r.doc_id) for r in odd.collect()) == ["7", "None"]
    assert sizes[:3] == [7, 7, 2] and sizes[3] == sizes[4] > 0


@pytest.mark.parametrize("name", [q for q in entry.queries() if q.startswith("op")])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
