"""Array functions over characters, token ids and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is computed anew for each element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def characters(text: Column) -> Column:
    """Code points of a text as an array; empty for empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def occurrences(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == item))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def padded(ids: Column, length: int, fill: int = 0) -> Column:
    """The first ``length`` items, filled up at the end."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), length)), 1, length)


def truncated(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def share_of(ids: Column, item: int) -> Column:
    """Number of entries equal to ``item``."""
    return F.size(F.filter(ids, lambda x: x == item))


def softmax(scores: Column) -> Column:
    def shifted(xs: Column) -> Column:
        powers = let(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top)))
        return let(powers, lambda es: let(F.aggregate(es, F.lit(0.0), lambda s, e: s + e), lambda total: F.transform(es, lambda e: e / total)))

    return let(scores, shifted)
