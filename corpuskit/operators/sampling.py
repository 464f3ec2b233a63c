"""Sampling filters over logits, as arrays per sequence (JVM functions, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions import arrays as A

NONE = float("-inf")


def repetition_penalty(logits: Column, generated: Column, penalty: float = 1.1) -> Column:
    """Logits of ids generated before, divided by the penalty if positive, else multiplied."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(generated, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def tempered(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda x: x / temperature)


def top_k(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become minus infinity; ties with it stay; no effect unless 0 < k < size."""
    if k <= 0:
        return logits

    def cut(xs: Column) -> Column:
        limit = F.get(F.sort_array(xs, asc=False), F.lit(k - 1))
        kept = A.let(limit, lambda low: F.transform(xs, lambda x: F.when(x < low, F.lit(NONE)).otherwise(x)))
        return F.when(F.lit(k) >= F.size(xs), xs).otherwise(kept)

    return A.let(logits, cut)


def top_p(logits: Column, p: float) -> Column:
    """Nucleus filter: a token stays if the mass of the tokens before it, by falling logit and then id, is at most p."""

    def cut(xs: Column) -> Column:
        weights = F.transform(A.softmax(xs), lambda x: -x)
        order = F.sort_array(F.arrays_zip(weights.alias("w"), F.sequence(F.lit(0), F.size(xs) - 1).alias("i")))
        start = F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<int>").alias("ids"))
        step = lambda s, z: F.struct((s.mass - z.w).alias("mass"), F.when(s.mass <= p, F.concat(s.ids, F.array(z.i))).otherwise(s.ids).alias("ids"))
        kept = F.aggregate(order, start, step, lambda s: s.ids)
        return A.let(kept, lambda ids: F.transform(xs, lambda x, i: F.when(F.array_contains(ids, i), x).otherwise(F.lit(NONE))))

    return A.let(logits, cut)


def greedy(logits: Column) -> Column:
    """Id of the largest logit, the first of equals."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def sample(logits: Column, u: Column, temperature: float = 1.0, k: int = 0, p: float = 1.0) -> Column:
    """Id drawn by the uniform number ``u``: temperature, top-k, top-p, softmax, inverse of the cumulative sum."""
    if temperature <= 0:
        return greedy(logits)
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("i"), F.lit(-1).alias("id"))
    pick = lambda s, x: F.struct((s.mass + x).alias("mass"), (s.i + 1).alias("i"), F.when((s.id < 0) & (u < s.mass + x), s.i).otherwise(s.id).alias("id"))
    drawn = F.aggregate(A.softmax(top_p(top_k(tempered(logits, temperature), k), p)), start, pick, lambda s: s.id)
    return A.let(drawn, lambda found: F.when(found < 0, greedy(logits)).otherwise(found))
