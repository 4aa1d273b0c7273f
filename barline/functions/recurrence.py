"""Linear recurrences y[t] = a[t] * y[t-1] + b[t] along a series, for any a and b.

Affine maps compose, so a series is cut into blocks: inside a block every row
composes its map with that of the row 1, 2, 4, ... before it (lags in one
window: no further shuffle or sort), a table of one row per block hands on what
the blocks before come to, and that is joined back. A hot series is spread over
as many tasks as it has blocks. Means of constant decay need no such table: see
``blocks.decayed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def linear_recurrences(df: DataFrame, maps: dict[str, tuple[Column, Column]], keys=("symbol",), order: str = "bar_idx", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds a column per entry of ``maps`` (name: (a, b)), all in one scan.

    ``order`` is a long column, dense enough to be cut into blocks. A row whose
    a or b is null repeats the value before it; before the first defined row
    the result is null. The first row's a is not used.
    """
    keys, names = list(keys), list(maps)
    parts = [(f"__a{i}", f"__b{i}", f"__k{i}") for i in range(len(maps))]
    given = {}
    for (a, b, k), (fa, fb) in zip(parts, maps.values()):
        fa = fa if isinstance(fa, Column) else F.lit(float(fa))
        given |= {a: fa.cast("double"), b: fb.cast("double"), k: fa.isNotNull() & fb.isNotNull()}
    rows = df.withColumns({**given, "__block": F.floor(F.col(order) / block_rows)})
    rows = rows.withColumns({x: F.when(F.col(k), F.col(x)).otherwise(rest) for a, b, k in parts for x, rest in ((a, 1.0), (b, 0.0))})
    w = Window.partitionBy(*keys, "__block").orderBy(order)
    step = 1
    while step < block_rows:
        rows = rows.withColumns({f"{x}_": F.lag(x, step).over(w) for part in parts for x in part})
        composed = {}
        for a, b, k in parts:
            there = F.col(f"{a}_").isNotNull()
            composed |= {a: F.when(there, F.col(a) * F.col(f"{a}_")).otherwise(F.col(a)), b: F.when(there, F.col(a) * F.col(f"{b}_") + F.col(b)).otherwise(F.col(b)), k: F.col(k) | F.coalesce(f"{k}_", F.lit(False))}
        rows = rows.withColumns(composed).drop(*[f"{x}_" for part in parts for x in part])
        step *= 2
    ends = rows.groupBy(*keys, "__block").agg(F.max_by(F.struct(*[x for part in parts for x in part]), order).alias("m"))
    ends = ends.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(F.struct("__block", "m"))).alias("ends"))  # a row per block_rows rows
    fields = [x for i in range(len(maps)) for x in (f"c{i}", f"d{i}")]
    handed = ", ".join(["__at: bigint", *[f"c{i}: double, d{i}: boolean" for i in range(len(maps))]])
    start = F.struct(F.expr(f"cast(array() as array<struct<{handed}>>)").alias("out"), *[x for i in range(len(maps)) for x in (F.lit(0.0).alias(f"c{i}"), F.lit(False).alias(f"d{i}"))])

    def hand_on(done: Column, end: Column) -> Column:
        mine = F.struct(end["__block"].alias("__at"), *[done[f].alias(f) for f in fields])
        after = [x for i, (a, b, k) in enumerate(parts) for x in ((end["m"][a] * done[f"c{i}"] + end["m"][b]).alias(f"c{i}"), (done[f"d{i}"] | end["m"][k]).alias(f"d{i}"))]
        return F.struct(F.concat(done["out"], F.array(mine)).alias("out"), *after)

    carried = ends.select(*[f"__key{i}" for i in range(len(keys))], F.explode(F.aggregate("ends", start, hand_on, lambda done: done["out"])).alias("c")).select(*[f"__key{i}" for i in range(len(keys))], "c.*")
    same = rows["__block"] == carried["__at"]
    for i, key in enumerate(keys):
        same = same & rows[key].eqNullSafe(carried[f"__key{i}"])
    done = rows.join(carried, same)
    value = lambda i: F.when(F.col(f"__k{i}") | F.col(f"d{i}"), F.col(f"__a{i}") * F.col(f"c{i}") + F.col(f"__b{i}"))
    return done.select(*[c for c in df.columns if c not in names], *[value(i).alias(name) for i, name in enumerate(names)])


def linear_recurrence(df: DataFrame, a: Column, b: Column, out: str, keys=("symbol",), order: str = "bar_idx", block_rows: int = BLOCK_ROWS) -> DataFrame:
    return linear_recurrences(df, {out: (a, b)}, keys, order, block_rows)


def ewm_map(value: Column, alpha: float, keys=("symbol",), order: str = "bar_idx") -> tuple[Column, Column]:
    """The maps of a recursive exponential mean that is seeded with the series' first value."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    return F.when(first, 0.0).otherwise(1.0 - alpha), F.when(first, value).otherwise(alpha * value)
