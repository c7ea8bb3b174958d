"""A value named once in an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)
