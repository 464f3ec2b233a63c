"""The Merkle manifest against a plain tree, on tables with nulls, repeats and blocks of every size."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string, `a.b` string, `row` int, node string, tampered boolean"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    i, source, lang, n, text = row
    values = (i, source, lang, None if n is None else n + more, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    return [(at >> k & 1, level[at >> k ^ 1] if at >> k ^ 1 < len(level) else "") for k, level in enumerate(levels[:-1])]


def plain(rows):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    for k, name in enumerate(names):
        for at, r in enumerate(groups[name]):
            path = siblings(trees[name], at) + siblings(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1) if bad else leaf(r)
            for side, other in path:
                node = h(other + node if side else node + other)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[name][-1][0], root, h("".join(s for _, s in path)), node, node == root))
    return out


def result(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "x", 1, "n", True) for r in rows], KIND).repartition(parts)
    return merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()


def same(a, b):
    assert sorted(map(str, map(tuple, a))) == sorted(map(str, b))


ODD = [(1, None, "en", 3, "abc"), (None, "s", "en", 1, "𠮷é"), (None, "s", "en", 1, "𠮷é"), (5, "", None, None, None), (6, "-", "", 0, ""), (7, "s", "é", 9, "x" * 300_000)]
ODD += [(7, "s", "z", 2**63 - 1, "y")] * 3 + [(-8, "a:b", "é", -5, "1:1"), (9, "s", "Z", 4, " \n")]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8])
def test_small(spark, n):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(n)]
    same(result(spark, rows), plain(rows))


def test_odd_rows(spark):
    same(result(spark, ODD), plain(ODD))
    found = {r.doc_id: r.verified for r in result(spark, [(i, "s", "en", None if i % 2 else i, "t") for i in range(60)])}
    assert {i for i, fine in found.items() if not fine} == {i for i in range(0, 60, 2) if zlib.crc32(str(i).encode()) % 7 == 0}


def test_blocks(spark, monkeypatch):
    """Languages of one block and of many, with last blocks of one row, over several ranges; more languages than a block has."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = list(ODD)
    for lang, n in (("en", 65), ("fr", 64), ("de", 17), ("es", 4), ("it", 3), (None, 33)):
        rows += [(1000 + i, "s", lang, i, f"{lang}{i}") for i in range(n)]
    # Workers take the module's own sizes, so blocks are packed and proved in this process.
    packed = defaultdict(list)
    for r in rows:
        packed[r[2]].append(leaf(r))
    for nodes in packed.values():
        levels, want = [merkle._rows("".join(nodes).encode())], tree(nodes)[-1][0]
        total = len(nodes)
        while total > merkle.BLOCK:
            tops = [merkle.climb(levels[-1][i : i + 4], total)[-1] for i in range(0, total, 4)]
            levels.append(np.concatenate(tops))
            total = -(-total // 4)
        assert merkle.climb(levels[-1], total)[-1].tobytes().decode() == want


def test_many_blocks(spark):
    rows = [(i * 3, "s", "en" if i % 5 else "fr", i, f"t{i}") for i in range(5 * merkle.BLOCK + 1)] + ODD
    same(result(spark, rows, 7), plain(rows))


def test_fanout(monkeypatch):
    monkeypatch.setattr(merkle, "FANOUT", 3)
    monkeypatch.setattr(merkle, "RECORD", 1 + 2 * merkle.WIDTH)
    nodes = [h(str(i)) for i in range(11)]
    levels = merkle.climb(merkle._rows("".join(nodes).encode()), 11)
    one = [h("".join(nodes[i : i + 3])) for i in range(0, 11, 3)]
    two = [h("".join(one[:3])), h(one[3])]
    assert levels[-1].tobytes().decode() == h("".join(two))
    folded = merkle.fold(levels[0], merkle.records(levels))
    assert {x.tobytes().decode() for x in folded} == {h("".join(two))}
