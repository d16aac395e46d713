"""Guarded arithmetic shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b; default where b is 0 or either is null."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default))


def trailing(keys: list[str], order: str, k: int, upto: int = 0) -> WindowSpec:
    """The last k rows of each group up to the current one (upto=-1: before it)."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(upto - k + 1, upto)


def so_far(keys: list[str], order: str, upto: int = 0) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)


def ordered(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles, from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The array scaled to length 1; a zero array stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def rounded(columns: list[str], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
