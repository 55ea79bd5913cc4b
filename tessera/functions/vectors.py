"""Column functions on vectors (arrays of numbers)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def dot_with(a: Column, q: Sequence[float]) -> Column:
    """Dot product with a vector that is known when the query is planned; one generated expression, no loop."""
    return reduce(lambda s, x: s + x, [F.get(a, F.lit(i)).cast("double") * float(x) for i, x in enumerate(q)])


def cosine_with(a: Column, q: Sequence[float]) -> Column:
    length = sum(float(x) ** 2 for x in q) ** 0.5
    own = F.sqrt(reduce(lambda s, x: s + x, [F.get(a, F.lit(i)).cast("double") * F.get(a, F.lit(i)).cast("double") for i in range(len(q))]))
    return F.when(own * length == 0, 0.0).otherwise(dot_with(a, q) / (own * length))


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def finite(a: Column) -> Column:
    """Whether all values are present and finite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
