"""Distances between vectors, in double precision."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two array columns; null if the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def l2_sq_to(vector: Column, query: Sequence[float]) -> Column:
    """Squared distance to a fixed vector, unrolled so that it stays in generated code.

    The sum runs from the first element to the last. Null if the vector is shorter; elements past
    the query's length don't count, so rows of other lengths should be filtered by size.
    """
    terms = []
    for i, q in enumerate(query):
        gap = F.get(vector, F.lit(i)).cast("double") - F.lit(float(q))
        terms.append(gap * gap)
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_sq(a, b))
