"""Signals aligned with candles: gap retests, moving averages with RSI, EMA crosses, plug-ins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline import ship
from barline.functions.blocks import in_blocks, reach
from barline.functions.frames import bars, holds
from barline.operators.indicators import add_atr, add_ema, add_emas_weighted, add_rsi, add_sma
from barline.operators.patterns import detect_fvg, first_retests


def align(candles: DataFrame, signals: DataFrame) -> DataFrame:
    """Every candle with its signal row by (symbol, datetime); none: signal 0."""
    return candles.join(signals, ["symbol", "datetime"], "left").withColumn("signal", F.coalesce("signal", F.lit(0)))


def fvg_signals(
    candles: DataFrame, reward: float = 3.0, max_age: int = 100, min_risk_atr: float = 0.25, tolerance: float = 1e-6, filter_percent: float = 0.5, volume_filter: bool = False
) -> DataFrame:
    """Candles with signal, entry_price, stop_price, take_price, size, risk.

    A gap in the direction of the EMA50 trend (at its base and at the entry) is
    entered at its mid on the first retest; the stop lies behind the four bars
    base-2..base+1, the target at ``reward`` times the risk. Gaps of too little
    risk against ATR14 are dropped; an undefined ATR passes. Of several gaps on
    one entry bar, the first by base bar, bullish first, that passes all filters wins.
    """
    block = bars().rowsBetween(-2, 1)
    volume_ok = F.lit(True)
    if volume_filter:
        volume_ok = holds(F.col("volume") > F.greatest(*[F.lag("volume", k).over(bars()) for k in (1, 2, 3)]))

    def around(d: DataFrame) -> DataFrame:
        d = add_atr(add_ema(d, 50, name="__ema"), 14, "__atr")
        return d.withColumns({"block_low": F.min("low").over(block), "block_high": F.max("high").over(block), "later": F.lead("bar_idx").over(bars()).isNotNull(), "volume_ok": volume_ok})

    with_means = in_blocks(candles, around, reach(1.0 - 2.0 / 51), 1)
    base = with_means.select("symbol", "bar_idx", F.col("close").alias("base_close"), F.col("__ema").alias("base_ema"), F.col("__atr").alias("base_atr"), "block_low", "block_high", "later", "volume_ok")
    gaps = detect_fvg(candles, filter_percent).join(base, ["symbol", "bar_idx"])
    up = F.col("type") == "bullish"
    trend = F.when(up, F.col("base_close") > F.col("base_ema")).otherwise(F.col("base_close") < F.col("base_ema"))
    gaps = gaps.filter((F.col("bar_idx") >= 3) & F.col("later") & trend & F.col("volume_ok"))
    gaps = first_retests(gaps, candles, {"entry_bar": tolerance}, max_age).filter("entry_bar is not null")
    at_entry = with_means.select("symbol", F.col("bar_idx").alias("entry_bar"), F.col("close").alias("entry_close"), F.col("__ema").alias("entry_ema"))
    gaps = gaps.join(at_entry, ["symbol", "entry_bar"])
    stop = F.when(up, F.col("block_low")).otherwise(F.col("block_high"))
    risk = F.when(up, F.col("mid") - stop).otherwise(stop - F.col("mid"))
    still = F.when(up, F.col("entry_close") > F.col("entry_ema")).otherwise(F.col("entry_close") < F.col("entry_ema"))
    gaps = gaps.withColumns({"stop_price": stop, "risk": risk}).filter(still & (F.col("risk") > 0) & ~holds(F.col("risk") < min_risk_atr * F.col("base_atr")))
    sign = F.when(up, 1).otherwise(-1)
    first = F.row_number().over(Window.partitionBy("symbol", "entry_bar").orderBy("bar_idx", F.when(up, 0).otherwise(1)))
    won = gaps.withColumn("__n", first).filter("__n = 1").select(
        "symbol", F.col("entry_bar").alias("bar_idx"), sign.alias("signal"), F.col("mid").alias("entry_price"), "stop_price", (F.col("mid") + sign * reward * F.col("risk")).alias("take_price"), "risk"
    )
    return candles.join(won, ["symbol", "bar_idx"], "left").withColumn("signal", F.coalesce("signal", F.lit(0))).withColumn("size", F.lit(1.0))


def ma_rsi_signals(candles: DataFrame, short: int = 9, long: int = 21, rsi_period: int = 14, buy: float = 55.0, sell: float = 45.0) -> DataFrame:
    """+1 where the short mean is above the long one and RSI above ``buy``; -1 the other way round."""
    means = lambda d: add_rsi(add_sma(add_sma(d, short, name="ma_short"), long, name="ma_long"), rsi_period, fill=50.0)
    df = in_blocks(candles, means, max(short, long, rsi_period + 1) - 1)
    rise = holds((F.col("ma_short") > F.col("ma_long")) & (F.col("rsi") > buy))
    fall = holds((F.col("ma_short") < F.col("ma_long")) & (F.col("rsi") < sell))
    return df.withColumn("signal", F.when(rise, 1).when(fall, -1).otherwise(0))


def ema_cross_signals(candles: DataFrame, fast: int = 9, slow: int = 21) -> DataFrame:
    """+1 where the fast weighted EMA is above the slow one, -1 below, 0 where equal."""
    df = add_emas_weighted(candles, {"ema_fast": fast, "ema_slow": slow})
    return df.withColumn("signal", F.when(F.col("ema_fast") > F.col("ema_slow"), 1).when(F.col("ema_fast") < F.col("ema_slow"), -1).otherwise(0))


Strategy = Callable[[DataFrame], DataFrame]


def run_strategy(candles: DataFrame, strategy: Strategy) -> DataFrame:
    """A plug-in's result, after checking its contract: a signal, and as many rows."""
    out = strategy(candles)
    if "signal" not in out.columns:
        raise ValueError("a strategy must return a column named signal")
    if out.count() != candles.count():
        raise ValueError("a strategy must return as many rows as it got")
    return out


def pandas_strategy(generate: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Strategy:
    """A strategy over one symbol's pandas frame as a strategy over all symbols."""

    def strategy(candles: DataFrame) -> DataFrame:
        ship(candles.sparkSession)
        return candles.groupBy("symbol").applyInPandas(lambda pdf: generate(pdf.sort_values("datetime").reset_index(drop=True)), schema)

    return strategy
