"""Keyed permutations and the sampling runs that rest on them."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.operators import cursor, mixing

CURRICULUM = [{"until_step": 40, "weights": {"a": 1.0, "b": 3.0}}, {"until_step": None, "weights": {"b": 1.0, "c": 2.0}}]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32 - 1))
def test_every_key_gives_a_permutation(n, key):
    got = cursor.permutation(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(got.tolist()) == list(range(n))


def test_keys_differ_and_large_sizes_stay_inside():
    n = 1000
    orders = {tuple(cursor.permutation(np.arange(n), np.full(n, n), np.full(n, k)).tolist()) for k in range(20)}
    assert len(orders) == 20
    first = [cursor.permutation(np.array([0]), np.array([n]), np.array([k]))[0] for k in range(2000)]
    assert len(set(first)) > 800 and abs(np.mean(first) - n / 2) < 30  # a place goes anywhere
    for size in (2**40 + 1, 2**53 + 1, 2**62 - 1):
        got = cursor.permutation(np.array([0, 5, size - 1]), np.full(3, size), np.full(3, 9))
        assert len(set(got.tolist())) == 3 and (got >= 0).all() and (got < size).all()
    assert len(cursor.permutation(np.array([], np.int64), np.array([], np.int64), np.array([], np.int64))) == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "a" if i < 7 else "b" if i < 30 else "c", 0) for i in range(90)] + [(None, "b", 0), (3, "a", 0), (500, None, 0), (501, "unused", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, row int").repartition(4).cache()


def test_epochs_use_every_document_once(spark, docs):
    weights = mixing.stages(spark, CURRICULUM, {"a": 1.0, "b": 1.0, "c": 1.0})
    found = cursor.sample(docs, 400, weights, per_step=4).collect()
    assert sorted(r.i for r in found) == list(range(400)) and all(r.step == r.i // 4 for r in found)
    sizes = {"a": 8, "b": 24, "c": 60}
    for source, size in sizes.items():
        mine = sorted((r for r in found if r.source == source), key=lambda r: r.i)
        assert [r.epoch for r in mine] == [k // size for k in range(len(mine))]
        want = sorted((r.doc_id if r.doc_id is not None else -1) for r in docs.collect() if r.source == source)
        for epoch in range(len(mine) // size):
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in mine[epoch * size : (epoch + 1) * size]) == want
    orders = [[r.doc_id for r in found if r.source == "b" and r.epoch == e] for e in (0, 1)]
    assert orders[0] != orders[1]


@pytest.mark.parametrize("first", [1, 161, 399])
def test_resume_anywhere(spark, docs, first):
    weights = mixing.stages(spark, CURRICULUM, {"a": 1.0, "b": 1.0, "c": 1.0})
    whole = {tuple(r) for r in cursor.sample(docs, 400, weights, per_step=4).collect() if r.i >= first}
    cursors = cursor.cursors_at(spark, first, weights, per_step=4)
    for given_cursors in (None, cursors):
        assert {tuple(r) for r in cursor.sample(docs, 400, weights, per_step=4, first=first, cursors=given_cursors).collect()} == whole


def test_same_draws_whatever_the_partitions(spark, docs):
    weights = mixing.stages(spark, CURRICULUM, {"a": 1.0, "b": 1.0, "c": 1.0})
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    runs = [{tuple(r) for r in cursor.sample(unique.repartition(k), 200, weights).collect()} for k in (1, 5)]
    assert runs[0] == runs[1]
    assert cursor.sample(docs.limit(0), 50, weights).count() == 0
