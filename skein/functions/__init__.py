"""Column functions; everything here stays inside the JVM unless its docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    The optimizer copies an expression to every place that names it, into lambdas too, where it would
    be computed again per element; a lambda's own variable isn't copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
