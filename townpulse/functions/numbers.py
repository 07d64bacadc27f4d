"""Shares and batch numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part, total, digits: int = 1) -> Column:
    """``part / total * 100`` rounded half to even; an empty total gives 0."""
    ratio = F.try_divide(part, total) * F.lit(100.0)
    return F.bround(F.coalesce(ratio, F.lit(0.0)), digits)


def batch_of(number, size: int) -> Column:
    """1-based batch of a 1-based running number."""
    column = F.col(number) if isinstance(number, str) else number
    return F.ceil(column / F.lit(size)).cast("bigint")
