"""Long series in blocks of rows, so that one hot series runs in many tasks.

Three ways, by how far back a value looks:

- frames of known length: every block carries the rows before (and after) it
  that its frames reach, as copies that go at the end (``in_blocks``);
- means that forget: the same, as far as weights of 2**-100 reach (``decayed``);
- running sums, extremes, counts and last values: windows inside blocks, and a
  table of one row per block that hands on what the blocks before hold
  (``running``).

A block is a range of ``bar_idx``, which counts a series' rows from 0 without
gaps, or for ``running`` any column that rises with the order, such as a month.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.frames import BLOCK, bars, so_far

BLOCK_ROWS = 1 << 16
#: Weights below this share of the newest value's are left out: a double has 53 bits.
FORGOTTEN = 2.0**-100


def in_blocks(df: DataFrame, body: Callable[[DataFrame], DataFrame], behind: int, ahead: int = 0, rows: int | None = None) -> DataFrame:
    """``body(df)``, whose windows are over ``bars()`` and look at most ``behind`` rows back and ``ahead`` rows on.

    Inside another call the outer one's blocks serve, so a pack of indicators is
    one shuffle; the outer call states how far all of them reach together.
    """
    if BLOCK in df.columns:
        return body(df)
    rows = rows or max(BLOCK_ROWS, behind // 8)
    first, last = F.greatest(F.expr(f"(bar_idx - {ahead}) div {rows}"), F.lit(0).cast("long")), F.expr(f"(bar_idx + {behind}) div {rows}")
    spread = df.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    return body(spread).filter(F.expr(f"bar_idx div {rows}") == F.col(BLOCK)).drop(BLOCK)


def reach(*decays: float) -> int:
    """How many rows back the means of ``decayed`` look."""
    return max(0 if d <= 0 else math.ceil(math.log(FORGOTTEN) / math.log(d)) for d in decays)


def _stretch(decay: float) -> int:
    """Rows (a power of two) over which weights may grow: decay**-rows stays below e**300, and one stretch back is all that counts."""
    return 1 << int(math.log2(-300 / math.log(decay)))


def decayed(df: DataFrame, means: dict[str, tuple[float, Column]], known: Column) -> DataFrame:
    """Adds name = sum of value * decay**(known rows since), per name: (decay, value).

    To be used inside ``in_blocks``. In a stretch of rows it is a plain running
    sum of values scaled up by decay**-(rows since the stretch began), scaled
    back; what the stretch before ended with is added, and older ones weigh
    nothing. Means of like decay share their stretches and windows. A row that
    is not ``known`` (its values are null) repeats the sum before it and is no
    step; before the first known row the sum is null.
    """
    df = df.withColumn("__k", F.count(F.when(known, 1)).over(so_far(bars())))
    flat = {name: F.last(v, ignorenulls=True).over(so_far(bars())) for name, (d, v) in means.items() if d <= 0}
    df = df.withColumns(flat) if flat else df
    for rows in sorted({_stretch(d) for d, _ in means.values() if d > 0}):
        mine = {name: (d, v) for name, (d, v) in means.items() if d > 0 and _stretch(d) == rows}
        at = F.greatest(F.col("__k") - 1, F.lit(0))
        df = df.withColumns({"__s": F.floor(at / rows), "__m": (at % rows).cast("double")})
        inside = so_far(Window.partitionBy("symbol", BLOCK, "__s").orderBy("bar_idx"))
        df = df.withColumns({name: F.coalesce(F.sum(v * F.pow(F.lit(d), -F.col("__m"))).over(inside), F.lit(0.0)) * F.pow(F.lit(d), F.col("__m")) for name, (d, v) in mine.items()})
        opens = F.col("__s") != F.lag("__s").over(bars())
        df = df.withColumns({f"__e_{name}": F.when(opens, F.lag(name).over(bars())) for name in mine})
        ended = {name: F.coalesce(F.last(f"__e_{name}", ignorenulls=True).over(so_far(bars())), F.lit(0.0)) for name in mine}
        df = df.withColumns({name: F.col(name) + ended[name] * F.pow(F.lit(d), F.col("__m") + 1) for name, (d, _) in mine.items()}).drop("__s", "__m", *[f"__e_{name}" for name in mine])
    return df.withColumns({name: F.when(F.col("__k") > 0, F.col(name)) for name in means}).drop("__k")


# --- running aggregates -----------------------------------------------------------

_OVER = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}


def hand_on(rows: DataFrame, totals: DataFrame, carried: dict[str, Column], keys, block: str = BLOCK) -> DataFrame:
    """``rows`` (left) with what the blocks before hold: ``carried`` are aggregates of ``totals`` (a row per block) over the blocks before."""
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    table = totals.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col(block).alias("__at"), *[c.over(before).alias(n) for n, c in carried.items()])
    same = [rows[k].eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    return rows.join(table, reduce(lambda a, b: a & b, same, rows[block].eqNullSafe(F.col("__at"))), "left").drop("__at", *[f"__key{i}" for i in range(len(keys))])


def running(df: DataFrame, out: dict[str, tuple[str, Column]], order: list[str | Column], block: Column, keys=("symbol",), backwards: bool = False) -> DataFrame:
    """Adds per name the ``sum``, ``count``, ``max``, ``min`` or ``last`` known value of all rows up to each row, itself included.

    ``backwards``: of all rows from it on, in the reversed order.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    df = df.withColumns({BLOCK: -block.cast("long") if backwards else block.cast("long"), **{f"__v_{n}": v for n, (_, v) in out.items()}})
    local = Window.partitionBy(*keys, BLOCK).orderBy(*[o.desc() if backwards else o for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({n: _OVER[kind](F.col(f"__v_{n}")).over(local) for n, (kind, _) in out.items()})
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    ends = F.min_by if backwards else F.max_by
    total = {n: (ends(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), at)) if kind == "last" else _OVER[kind](F.col(f"__v_{n}"))) for n, (kind, _) in out.items()}
    totals = df.groupBy(*keys, BLOCK).agg(*[t.alias(n) for n, t in total.items()])
    carried = {f"__c_{n}": (F.sum(n) if kind in ("sum", "count") else _OVER[kind](F.col(n))) for n, (kind, _) in out.items()}
    rows = hand_on(rows, totals, carried, keys)

    def whole(n: str, kind: str) -> Column:
        mine, before = F.col(n), F.col(f"__c_{n}")
        if kind in ("sum", "count"):
            return F.when(mine.isNull(), before).otherwise(mine + F.coalesce(before, F.lit(0)))
        return F.greatest(mine, before) if kind == "max" else F.least(mine, before) if kind == "min" else F.coalesce(mine, before)

    return rows.withColumns({n: whole(n, kind) for n, (kind, _) in out.items()}).drop(BLOCK, *[f"{p}{n}" for n in out for p in ("__v_", "__c_")])


def positions(df: DataFrame, name: str, order: list[str | Column], block: Column, keys=("symbol",), backwards: bool = False) -> DataFrame:
    """Adds each row's number in its series, from 1; ``order`` leaves no ties."""
    return running(df, {name: ("count", F.lit(1))}, order, block, keys, backwards).withColumn(name, F.col(name).cast("long"))


def month(time: Column | str) -> Column:
    """A block for series that are ordered by time."""
    time = F.col(time) if isinstance(time, str) else time
    return (F.year(time) * 12 + F.month(time)).cast("long")


def day(time: Column | str) -> Column:
    """A block for dense series that are ordered by time."""
    return F.unix_date(F.to_date(F.col(time) if isinstance(time, str) else time)).cast("long")


def bar_block(order: str = "bar_idx") -> Column:
    """The block of a row by its bar_idx, or another number that counts rows."""
    return F.expr(f"`{order}` div {BLOCK_ROWS}")
