"""Vectorized functions that are made into UDFs when they are first used, not at import (workers import without a session)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Make a function over pandas Series an expression of the given type (DDL)."""

    def wrap(function: Callable) -> Callable[..., Column]:
        @functools.wraps(function)
        def apply(*columns: Column | str) -> Column:
            return F.pandas_udf(function, kind)(*columns)

        return apply

    return wrap
