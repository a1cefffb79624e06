"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def softplus(x: Column) -> Column:
    """log(1 + e**x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def share(condition: Column) -> Column:
    """Aggregate: part of the rows for which a condition holds."""
    return F.avg(condition.cast("double"))
