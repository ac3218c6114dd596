"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    """The inner product, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """The cosine, with a small number added to the lengths' product."""
    return dot(a, b) / (norm(a) * norm(b) + epsilon)


def scaled(a: Column, by: Column) -> Column:
    """Every element divided by a number."""
    return F.transform(a, lambda x: x.cast("double") / by)


def linear_size(value: Column, top: Column, least: float, span: float) -> Column:
    """A display size: least at 0, least + span at the top; a top of 0 counts as 1."""
    return F.lit(least) + F.lit(span) * value / F.when(top == 0, 1).otherwise(top)
