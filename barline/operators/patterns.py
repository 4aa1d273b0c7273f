"""Price gaps, their first retest and lifetime, swing breaks and order blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.blocks import in_blocks
from barline.functions.frames import bars, holds, over_zero
from barline.operators.indicators import add_swings

MAX_AGE = 100


def detect_fvg(df: DataFrame, filter_percent: float = 0.5) -> DataFrame:
    """Three-candle gaps: symbol, bar_idx (of the third), type, top, bottom, mid, gap_pct.

    A bar may open a gap upwards and downwards; all comparisons are strict.
    """
    h0, h1, l0, l1 = F.lag("high", 2).over(bars()), F.lag("high", 1).over(bars()), F.lag("low", 2).over(bars()), F.lag("low", 1).over(bars())
    df = in_blocks(df.select("symbol", "bar_idx", "high", "low"), lambda d: d.withColumns({"h0": h0, "h1": h1, "l0": l0, "l1": l1}), 2).withColumnsRenamed({"high": "h2", "low": "l2"})
    up = F.coalesce((F.col("l2") - F.col("h0")) / over_zero(F.col("l2")) * 100, F.lit(0.0))
    down = F.coalesce((F.col("l0") - F.col("h2")) / over_zero(F.col("l0")) * 100, F.lit(0.0))

    def gap(kind: str, top: str, bottom: str, pct: Column) -> Column:
        t, b = F.col(top), F.col(bottom)
        return F.struct(F.lit(kind).alias("type"), t.alias("top"), b.alias("bottom"), ((t + b) / 2).alias("mid"), pct.alias("gap_pct"))

    bullish = F.when(F.expr("h0 < l2 and h0 < h1 and l0 < l2") & (up > filter_percent), gap("bullish", "l2", "h0", up))
    bearish = F.when(F.expr("l0 > h2 and l0 > l1 and h0 > h2") & (down > filter_percent), gap("bearish", "l0", "h2", down))
    return df.select("symbol", "bar_idx", F.explode(F.array_compact(F.array(bullish, bearish))).alias("g")).select("symbol", "bar_idx", "g.*")


def first_retests(gaps: DataFrame, candles: DataFrame, tolerances: dict[str, float], max_age: int = MAX_AGE, inclusive: bool = False) -> DataFrame:
    """Adds, per name in ``tolerances``, the first bar whose range holds the gap's mid.

    Bars up to ``max_age`` after the gap count (the gap's own too if
    ``inclusive``). A range join by buckets of max_age bars: each gap meets two
    buckets, in an equi-join; all tolerances are answered in this one join.
    """
    first = F.col("bar_idx") + (0 if inclusive else 1)
    spans = gaps.select("symbol", "bar_idx", "type", "mid", F.explode(F.sequence(F.floor(first / max_age), F.floor((F.col("bar_idx") + max_age) / max_age))).alias("bucket"))
    reach = candles.select("symbol", F.floor(F.col("bar_idx") / max_age).alias("bucket"), F.col("bar_idx").alias("bar"), "low", "high")
    met = spans.join(reach, ["symbol", "bucket"]).filter((F.col("bar") >= first) & (F.col("bar") <= F.col("bar_idx") + max_age))
    touch = lambda tol: (F.col("low") - F.col("mid") * tol <= F.col("mid")) & (F.col("mid") <= F.col("high") + F.col("mid") * tol)
    found = met.groupBy("symbol", "bar_idx", "type").agg(*[F.min(F.when(touch(t), F.col("bar"))).alias(n) for n, t in tolerances.items()])
    return gaps.join(found, ["symbol", "bar_idx", "type"], "left")


def fvg_lifetimes(gaps: DataFrame, candles: DataFrame, max_age: int = MAX_AGE, inclusive: bool = False) -> DataFrame:
    """Adds end_bar (first retest, else the last bar in reach), start_time, end_time (epoch seconds)."""
    found = first_retests(gaps, candles, {"__retest": 0.0}, max_age, inclusive)
    lengths = candles.groupBy("symbol").agg((F.max("bar_idx")).alias("__last"))
    found = found.join(lengths, "symbol").withColumn("end_bar", F.coalesce("__retest", F.least(F.col("bar_idx") + max_age, F.col("__last")))).drop("__retest", "__last")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast(dict(candles.dtypes)["datetime"]), F.col("datetime"))
    times = candles.select("symbol", F.col("bar_idx").alias("__bar"), seconds.alias("__time"))
    start, end = times.toDF("symbol", "__start", "start_time"), times.toDF("symbol", "end_bar", "end_time")
    found = found.withColumn("__start", F.col("bar_idx") - 2)
    return found.join(start, ["symbol", "__start"], "left").join(end, ["symbol", "end_bar"], "left").drop("__start")


def detect_orderblocks(df: DataFrame, lookback: int = 5) -> DataFrame:
    """Breaks of the swing before -> the last opposite candle in the ``lookback`` bars before.

    One row per break: symbol, bos_bar_idx, bar_idx (of the block), type, top,
    bottom, mid. A candle that several breaks share has several rows.
    """
    before = bars().rowsBetween(-lookback, -1)
    body = F.struct(F.col("bar_idx").alias("bar_idx"), F.greatest("open", "close").alias("top"), F.least("open", "close").alias("bottom"))
    red = F.last(F.when(F.col("close") < F.col("open"), body), ignorenulls=True).over(before)
    green = F.last(F.when(F.col("close") > F.col("open"), body), ignorenulls=True).over(before)
    broke_up, broke_down = F.col("close") > F.lag("swing_high").over(bars()), F.col("close") < F.lag("swing_low").over(bars())
    block = lambda kind, b: F.when(b.isNotNull(), F.struct(F.lit(kind).alias("type"), b.alias("b")))
    found = F.array_compact(F.array(F.when(holds(broke_up), block("bullish", red)), F.when(holds(broke_down), block("bearish", green))))
    df = in_blocks(df, lambda d: add_swings(d, lookback).withColumn("found", found), 2 * lookback)
    marked = df.select("symbol", F.col("bar_idx").alias("bos_bar_idx"), "found")
    rows = marked.select("symbol", "bos_bar_idx", F.explode("found").alias("o")).select("symbol", "bos_bar_idx", "o.type", "o.b.*")
    return rows.withColumn("mid", (F.col("top") + F.col("bottom")) / 2)
