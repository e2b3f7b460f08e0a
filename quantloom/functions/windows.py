"""Window expressions over bars. All take the keys of a series; equal windows share one sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol",)


def series(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts")


def trailing(n: int, keys: tuple[str, ...] = KEYS) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return series(keys).rowsBetween(1 - n, 0)


def running(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return series(keys).rowsBetween(Window.unboundedPreceding, 0)


def roll(f: Callable[[Column], Column], x: Column, n: int, keys: tuple[str, ...] = KEYS) -> Column:
    """f over n rows; null until there are n, and where one of them is null."""
    w = trailing(n, keys)
    return F.when(F.count(x).over(w) == n, f(x).over(w))


def lag(x: Column, n: int = 1, keys: tuple[str, ...] = KEYS) -> Column:
    return F.lag(x, n).over(series(keys))


def diff(x: Column, n: int = 1, keys: tuple[str, ...] = KEYS) -> Column:
    return x - lag(x, n, keys)


def pct_change(x: Column, n: int = 1, keys: tuple[str, ...] = KEYS) -> Column:
    """x over its value n rows ago, less one; x must not be null in between."""
    return ratio(x, lag(x, n, keys)) - 1


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null, though greatest and least skip nulls."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def average_rank(x: Column, keys: list[str]) -> Column:
    """Rank from 1 with ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2
