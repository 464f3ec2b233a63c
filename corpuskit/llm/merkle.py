"""Merkle manifest of a dataset: a hash tree for each language, a tree over their roots, a proof for every row.

A leaf is the digest of a row's fields. The leaves of a language, numbered in the order of their ids,
are cut into aligned blocks of ``FANOUT ** HEIGHT``; a block is a contiguous numpy matrix of
64-byte hex digests, which is reshaped by the fanout and hashed row by row, level by level. The
digests of the blocks are the nodes of the next blocks, until a language has one block. The
languages' roots are the leaves of the last tree.

Proofs come down the same blocks: in a block the siblings of all leaves at a level are found by
index arithmetic, and what stands above a block is handed to it as one string. A task holds a few
blocks at a time, whatever the size of a language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.plans.durable import cut

FANOUT = 2
HEIGHT = 10
BLOCK = FANOUT**HEIGHT
#: Hex digits of a digest.
WIDTH = 64
#: A level of a path: the node's place in its run, then the run's other nodes, filled up with blanks.
RECORD = 1 + (FANOUT - 1) * WIDTH
BLANK, ZERO = ord(" "), ord("0")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of about one task of the numbering.
PART_ROWS = 200_000


def field(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` if null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _rows(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, WIDTH)


def _hashed(matrix: np.ndarray) -> list[str]:
    """Digests of the rows of a matrix without the blanks that fill them up."""
    return [hashlib.sha256(row.tobytes().replace(b" ", b"")).hexdigest() for row in matrix]


def _up(nodes: np.ndarray) -> np.ndarray:
    """The level above: every run of ``FANOUT`` consecutive nodes, the last of them maybe shorter, becomes one."""
    whole = len(nodes) // FANOUT * FANOUT
    digests = _hashed(nodes[:whole].reshape(-1, FANOUT * WIDTH))
    if whole < len(nodes):
        digests += _hashed(nodes[whole:].reshape(1, -1))
    return _rows("".join(digests).encode())


def climb(nodes: np.ndarray, total: int) -> list[np.ndarray]:
    """Levels of a block of a row of ``total`` nodes: up to one node if it is the only block, else ``HEIGHT`` levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if total <= BLOCK else len(levels) <= HEIGHT:
        levels.append(_up(levels[-1]))
    return levels


def records(levels: list[np.ndarray]) -> np.ndarray:
    """Paths of all nodes of the lowest level, a matrix of a ``RECORD`` for each level but the topmost."""
    n, out = len(levels[0]), []
    at = np.arange(n)
    for nodes in levels[:-1]:
        place = at % FANOUT
        found = np.full((n, RECORD), BLANK, np.uint8)
        found[:, 0] = ZERO + place
        for k in range(FANOUT - 1):
            other = at - place + k + (k >= place)
            there = np.nonzero(other < len(nodes))[0]
            found[there, 1 + k * WIDTH : 1 + (k + 1) * WIDTH] = nodes[other[there]]
        out.append(found)
        at = at // FANOUT
    return np.concatenate(out, axis=1) if out else np.zeros((n, 0), np.uint8)


def fold(nodes: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """Roots recomputed from nodes and their paths."""
    for at in range(0, paths.shape[1], RECORD):
        place, others = paths[:, at] - ZERO, paths[:, at + 1 : at + RECORD]
        runs = np.empty((len(nodes), FANOUT * WIDTH), np.uint8)
        for k in range(FANOUT):
            own, before = place == k, others[:, (k - 1) * WIDTH : k * WIDTH]
            after = others[:, k * WIDTH : (k + 1) * WIDTH]
            runs[own, k * WIDTH : (k + 1) * WIDTH] = nodes[own]
            if k:
                runs[place < k, k * WIDTH : (k + 1) * WIDTH] = before[place < k]
            if k < FANOUT - 1:
                runs[place > k, k * WIDTH : (k + 1) * WIDTH] = after[place > k]
        nodes = _rows("".join(_hashed(runs)).encode())
    return nodes


def ranked(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """Adds ``rank``, from 0 in each group, and ``total``, the rows of the group.

    Ranges of group and order are sorted, so a row's place in its range and the number of rows of
    its group in the ranges before make its rank; a group of any size is dealt over many ranges.
    """
    keys = [F.col(c) for c in (group, *order)]
    rows = rows.repartitionByRange(max(1, -(-n // PART_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
    rows = cut(rows.sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    spans = rows.groupBy(part.alias("part"), group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("part", F.col(group).alias("g"), "first", before.alias("before"), F.sum("n").over(whole).alias("total"))
    joined = rows.join(spans, (part == F.col("part")) & F.col(group).eqNullSafe(F.col("g")))
    return joined.withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "g", "first", "before")


def _pack(group: pa.Table) -> pa.Table:
    """A block's rows as one: its nodes in order as one string, its digest, and of leaves the ids and the tampered digests."""
    group = group.sort_by("rank").combine_chunks()
    total, nodes = group.column("total")[0].as_py(), "".join(group.column("node").to_pylist())
    out = {name: group.column(name)[:1] for name in ("lang", "block", "total")}
    out |= {"nodes": pa.array([nodes]), "digest": pa.array([climb(_rows(nodes.encode()), total)[-1].tobytes().decode()])}
    if "doc_id" in group.column_names:
        out["doc_ids"] = pa.array([group.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        out["tampered"] = pa.array([group.column("tampered").to_pylist()], pa.list_(pa.string()))
    return pa.table(out)


def blocks(nodes: DataFrame) -> list[DataFrame]:
    """Tables of the blocks of every level over ``nodes(lang, rank, total, node)``, lowest first."""
    kind, out = "lang string, block long, total long, nodes string, digest string", []
    while True:
        more = ", doc_ids array<long>, tampered array<string>" if "doc_id" in nodes.columns else ""
        rows = nodes.withColumn("block", F.expr(f"rank div {BLOCK}"))
        out.append(cut(rows.groupBy("lang", "block").applyInArrow(_pack, kind + more)))
        above = out[-1].where(F.col("total") > BLOCK)
        if above.isEmpty():
            return out
        nodes = above.selectExpr("lang", "block AS rank", f"(total + {BLOCK - 1}) div {BLOCK} AS total", "digest AS node")


def tops(levels: list[DataFrame]) -> DataFrame:
    """``(lang, digest)``: the root of each language."""
    out = None
    for level in levels:
        found = level.where(F.col("total") <= BLOCK).select("lang", "digest")
        out = found if out is None else out.unionByName(found)
    return out


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of blocks with what stands above them."""
    for batch in batches:
        for row in batch.to_pylist():
            paths = records(climb(_rows(row["nodes"].encode()), row["total"]))
            found = [p.tobytes().decode() + row["above"] for p in paths]
            first, n = row["block"] * BLOCK, len(found)
            columns = ([row["lang"]] * n, list(range(first, first + n)), found, [row["subroot"]] * n)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang2", "rank", "above", "subroot"])


def paths_below(given: DataFrame) -> DataFrame:
    """``(lang2, rank, above, subroot)`` of all nodes of blocks that know what stands above them."""
    return given.select("lang", "block", "total", "nodes", "above", "subroot").mapInArrow(_children, "lang2 string, rank long, above string, subroot string")


def handed_down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """Adds to the lowest blocks ``above``, the path from them on, and ``subroot``.

    ``top(lang2, above, subroot)`` has these for the root of each language; it is joined with a block
    of each language alone, and blocks with the one row of the node that they are in the block above.
    """
    same, given = F.col("lang").eqNullSafe(F.col("lang2")), None
    for level in reversed(levels):
        found = level.where(F.col("total") <= BLOCK).join(top, same).drop("lang2")
        if given is not None:
            inner = level.where(F.col("total") > BLOCK).join(paths_below(given), same & (F.col("block") == F.col("rank")))
            found = found.unionByName(inner.drop("lang2", "rank"))
        given = found
    return given


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(root: str):
    """Proofs and recomputed roots of the leaves of blocks."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves = _rows(row["nodes"].encode())
                own, above = records(climb(leaves, row["total"])), np.frombuffer(row["above"].encode(), np.uint8)
                paths = np.concatenate((own, np.broadcast_to(above, (len(own), len(above)))), axis=1)
                siblings = np.delete(paths, np.arange(0, paths.shape[1], RECORD), axis=1)
                given = leaves.copy()
                for i, digest in enumerate(row["tampered"]):
                    if digest is not None:
                        given[i] = np.frombuffer(digest.encode(), np.uint8)
                text, n = [x.tobytes().decode() for x in leaves], len(leaves)
                folded = [x.tobytes().decode() for x in fold(given, paths)]
                columns = (text, [row["subroot"]] * n, [root] * n, _hashed(siblings), folded)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), *[pa.array(c, pa.string()) for c in columns], pa.array([f == root for f in folded])], names)

    return run


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", count_col: str = "n_chars") -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, a row per row of ``docs``.

    Rows for which ``tampered`` holds are verified as if ``count_col`` were one more; a null count
    stays, so they pass. Leaves of a group ascend by id, null first, and by digest where ids repeat;
    repeated rows are leaves of their own. A null group is one of its own, the first. No rows give no
    rows. Other columns have no part in it.
    """
    values = {c: F.col(f"`{c}`") for c in fields}
    more = values | {count_col: F.when(values[count_col].isNotNull(), values[count_col].cast("decimal(38,0)") + 1)}
    asked = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{group_col}`").cast("string").alias("lang"),
        leaf(list(values.values())).alias("node"),
        F.when(asked, leaf(list(more.values()))).alias("tampered"),
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    levels = blocks(ranked(rows, "lang", ["doc_id", "node", "row"], rows.count()).drop("row"))
    roots = cut(tops(levels).select(F.col("lang").alias("name"), F.lit("").alias("lang"), F.col("digest").alias("node")))
    languages = cut(ranked(roots, "lang", ["name"], roots.count()))
    upper = blocks(languages.drop("name"))
    found = tops(upper).first()
    if found is None:
        return docs.sparkSession.createDataFrame([], PROOF)
    begin = docs.sparkSession.createDataFrame([("", "", "")], "lang2 string, above string, subroot string")
    paths = paths_below(handed_down(upper, begin)).select(F.col("rank").alias("rank2"), "above")
    top = languages.join(paths, F.col("rank") == F.col("rank2")).select(F.col("name").alias("lang2"), "above", F.col("node").alias("subroot"))
    given = handed_down(levels, cut(top)).select("total", "nodes", "doc_ids", "tampered", "above", "subroot")
    return given.mapInArrow(_proofs(found.digest), PROOF)
