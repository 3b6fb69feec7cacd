"""Name an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside array lambdas Spark evaluates a repeated sub-expression every time
    it appears; a one-element ``transform`` binds it to a variable instead."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
