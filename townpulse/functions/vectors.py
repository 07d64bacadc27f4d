"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left, right) -> Column:
    """Inner product of two arrays of equal length."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector) -> Column:
    """The vector scaled to length 1. Its length is summed once, not once for each number."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(F.array(norm(column)), lambda length: F.transform(column, lambda x: x / length))[0]


def cosine(left, right) -> Column:
    """Cosine of the angle; null when a vector has length 0."""
    return F.try_divide(dot(left, right), norm(left) * norm(right))
