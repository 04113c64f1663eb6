"""Scalar functions as Column expressions: they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: a lambda's variable instead of a copy."""
    return F.get(F.transform(F.array(value), use), 0)
