"""Retrieval packing: every id in one piece, full sequences, and BM25 neighbours against plain formulas."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuskit.llm import packing

PATH = P.path("word_bpe_49k.json")
KIND = "doc_id long, text string, start string, ids int, kind string, shard int, `a.b` int"


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    topics = [[f"{t}{w}" for w in "river stone maple engine copper window garden basket thunder pepper".split()] for t in ("", "un", "re")]
    texts = [" ".join(rng.choices(topics[i % 3], k=rng.randint(1, 400))) for i in range(n)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (903, "!"), (None, "no id"), (None, None)]
    rows += [(904, " ".join(rng.choices(topics[0], k=30_000)))] + [(905 + i, texts[4]) for i in range(60)] + [(7, texts[7])] * 2
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "x", 1, "k", 9, 2) for i, t in rows], KIND).repartition(parts)


@pytest.fixture(scope="module", autouse=True)
def tokenizer():
    encode.tokenizer = Tokenizer.from_file(PATH)


def encode(text):
    return encode.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, pieces, window):
    want = Counter((i, tuple(encode(t))) for i, t in rows)
    # Rows of one id and length are told apart by their ids, so pieces are laid out by chains of starts.
    by_doc = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2")
        assert p.length == len(ids) > 0 and p.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        by_doc[p.doc_id, p.doc_tokens].append((p.start, tuple(ids.tolist())))
    for (i, n), docs in ((k, [d for d in want.elements() if (d[0], len(d[1])) == k]) for k in {(d, len(x)) for d, x in want}):
        got = by_doc.pop((i, n))
        assert sum(len(x) for _, x in got) == n * len(docs)
        for start, ids in got:
            assert any(d[1][start : start + len(ids)] == ids for d in docs)
        assert sorted(s for s, _ in got if s == 0) == [0] * len(docs)
        places = Counter(k for s, x in got for k in range(s, s + len(x)))
        assert set(places.values()) == {len(docs)} and len(places) == n
    assert not by_doc
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two


@pytest.mark.parametrize("window,units", [(4096, 1024), (512, 16), (64, 1000)])
def test_every_id_once(spark, window, units):
    rows = corpus()
    check(rows, packing.pack(frame(spark, rows), PATH, window=window, units=units, with_ids=True).collect(), window)


def test_small_tables(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0
    found = packing.pack(frame(spark, [(1, None)]), PATH).collect()
    assert [tuple(r)[:5] for r in found] == [(1, 0, 1, zlib.crc32(b"\2\0\0\0"), 1)]
    exact = "river " * 4095  # with the end id just a window
    found = packing.pack(frame(spark, [(5, exact)]), PATH).collect()
    assert [(r.start, r.length, r.doc_tokens) for r in found] == [(0, 4096, 4096)]
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), PATH, window=1000)


def test_counts_cover_whole_texts(spark):
    rows = corpus()
    stats = packing.encoded(frame(spark, rows), PATH).where(F.col("kind") == packing.STATS).collect()
    got = Counter()
    for r in stats:
        got.update(dict(zip(r.terms, r.counts)))
    want = Counter(t for _, text in rows for t in set(encode(text)[:-1]))
    assert got == want and sum(r.n_docs for r in stats) == len(rows)


def bm25(units, weights, mean, q, d):
    score, counts = 0.0, Counter(units[d])
    for t in set(units[q]):
        f = counts[t]
        score += weights[t] * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(units[d]) / mean)) if f else 0
    return score


def test_index_against_the_formula():
    rng = np.random.default_rng(5)
    units = [rng.integers(0, 40, rng.integers(0, 60)) for _ in range(50)]
    df = np.array([sum(t in u for u in units) for t in range(40)])
    weights = packing.idf(50, df)
    assert weights[0] == pytest.approx(max(0, math.log((50 - df[0] + 0.5) / (df[0] + 0.5)))) and packing.idf(10, np.array([5]))[0] == 0
    index = packing.Index(units, weights, 30.0)
    for q in range(50):
        want = [bm25([u.tolist() for u in units], weights, 30.0, q, d) for d in range(50)]
        assert index.scores(q) == pytest.approx(want)


def test_windows_take_the_best_unused_neighbours():
    rng = np.random.default_rng(6)
    units = [rng.integers(0, 300, rng.integers(5, 40)) for _ in range(80)]
    weights = packing.idf(80, np.array([sum(t in u for u in units) for t in range(300)]))
    index = packing.Index(units, weights, 20.0)
    plain, sizes, used = [u.tolist() for u in units], [len(u) for u in units], set()
    for pieces in packing.fill(index, sizes, 128):
        if sum(n for _, _, n in pieces) < 128:
            break
        seed, *rest = [u for u, _, _ in pieces]
        used.add(seed)
        for u in rest:
            assert u not in used
            best = max(bm25(plain, weights, 20.0, seed, d) for d in range(80) if d not in used)
            assert bm25(plain, weights, 20.0, seed, u) == pytest.approx(best)
            used.add(u)


def test_similar_documents_meet(spark):
    """Documents of a topic share sequences far more often than chance, also where each shard is small."""
    rows = [(i, t) for i, t in corpus(300, 9) if i is not None and i < 300]
    found = packing.pack(frame(spark, rows), PATH, window=1024, units=64).groupBy("sequence_id").agg(F.collect_set("doc_id").alias("docs")).collect()
    pairs = [(a % 3 == b % 3) for r in found for a in r.docs for b in r.docs if a < b]
    assert sum(pairs) > 0.8 * len(pairs)
