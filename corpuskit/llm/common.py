"""Shared pieces of the training-data operators: joins of hot keys, names of columns and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.plans.durable import cut

#: The word class of every contract here: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def plain_names(docs: DataFrame, own: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns renamed but for ``own``, and a function that selects them and names them back.

    So columns with dots in their names, or with names of the operator's own, take part in nothing.
    """
    names = [c if c in own else f"__own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key is hot from this many rows on, and at least from the ``HOT_KEYS``-th part of all rows.
HOT_ROWS, HOT_KEYS = 500, 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, right_key: str, by: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, one row per key, where rows of a hot key are dealt to several tasks.

    At most ``HOT_KEYS`` keys are hot, so their table may be broadcast. The rows of a hot key are salted
    by a hash of the columns ``by``, and its row of ``right`` is repeated for each salt.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    most = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = cut(counts.where(F.col("__n") >= most).select(F.col(key).alias("__hot"), F.ceil(F.col("__n") / most).cast("int").alias("__salts")))
    left = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), "__salts").cast("int"), F.lit(0))).drop("__hot", "__salts")
    right = right.join(F.broadcast(hot), F.col(right_key) == F.col("__hot"), "left").withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hot", "__salts")
    return left.join(right, (F.col(key) == F.col(right_key)) & (F.col("__salt") == F.col("__salt2")), how).drop("__salt", "__salt2")


#: Rows of a small table that one task and one checkpoint file hold.
PART_ROWS = 50_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component being the smallest node.

    Each round hooks every node to its smallest neighbour, shortens the hooks by pointer jumping
    until they end at roots and contracts the edges to the roots. Jumps double their reach and
    roots grow fewer by rounds, so both numbers grow with the logarithm of the longest chain.
    Self-loops and repeated edges are allowed; nodes without an edge to another node are not
    returned. Nothing is collected: each round is a partially aggregated group-by and joins that
    adaptive execution can split where one component holds most nodes. The number of partitions
    follows that of the edges left, of which the tables of a round have twice as many rows at most.
    """

    def small(df: DataFrame, n: int) -> DataFrame:
        return cut(df.coalesce(max(1, -(-n // PART_ROWS))))

    edges = cut(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    hooks: list[tuple[DataFrame, int]] = []
    while len(hooks) < max_rounds and (n := 2 * edges.count()):
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        hook = small(both.groupBy("a").agg(F.min("b").alias("b")).selectExpr("a AS node", "least(a, b) AS up", "true AS moved"), n)
        while not hook.where("moved").isEmpty():
            jump = hook.selectExpr("node AS up", "up AS top")
            hook = small(hook.join(jump, "up").selectExpr("node", "top AS up", "top <> up AS moved"), n)
        hook = hook.drop("moved")
        hooks.append((hook, n))
        left = hook.selectExpr("node AS a", "up AS a2")
        right = hook.selectExpr("node AS b", "up AS b2")
        moved = edges.join(left, "a").join(right, "b").where("a2 <> b2")
        edges = small(moved.selectExpr("least(a2, b2) AS a", "greatest(a2, b2) AS b").distinct(), n)
    if len(hooks) == max_rounds and not edges.isEmpty():
        raise RuntimeError(f"components: not contracted after {max_rounds} rounds")
    if not hooks:
        return edges.selectExpr("a AS node", "b AS component")
    out = hooks[0][0].selectExpr("node", "up AS component")
    for hook, _ in hooks[1:]:
        step = hook.selectExpr("node AS component", "up AS next")
        out = out.join(step, "component", "left").selectExpr("node", "coalesce(next, component) AS component")
    return small(out, hooks[0][1])
