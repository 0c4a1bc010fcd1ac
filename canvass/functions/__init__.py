"""Scalar functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(f: Callable, returns) -> Callable[..., Column]:
    """A Python function over Arrow batches, registered only when it is used: workers import modules without a session."""
    return lambda *columns: F.udf(f, returns, useArrow=True)(*columns)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once: an expression that names its input several times would else hold it as often, and nested ones grow with every level."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
