"""Window frames with the full-window rule, and null-safe comparisons."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys=("symbol",), order: str = "datetime") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


#: The column of a row's block; see barline.functions.blocks.
BLOCK = "__block"


def bars() -> WindowSpec:
    """The bars of one block of a symbol in order, with the rows around it that frames reach."""
    return series(("symbol", BLOCK), "bar_idx")


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(aggregate, value: Column, w: WindowSpec, n: int) -> Column:
    """``aggregate`` over the last n rows, null until n values are there."""
    frame = last_n(w, n)
    return F.when(F.count(value).over(frame) == n, aggregate(value).over(frame))


def holds(condition: Column) -> Column:
    """A predicate in which unknown is false."""
    return F.coalesce(condition, F.lit(False))


def over_zero(value: Column) -> Column:
    """Null instead of zero, for denominators."""
    return F.when(value != 0, value)
