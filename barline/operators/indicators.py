"""Indicators as window expressions inside blocks of bars.

Every function adds columns to candles with symbol, datetime, bar_idx (a
symbol's bars counted from 0, without gaps) and OHLCV. Windows run over
(symbol, block): a block carries the bars before it that a frame, or a
recursive mean, reaches; cumulative ones get what the blocks before hold from a
table of one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.blocks import bar_block, decayed, hand_on, in_blocks, reach, running
from barline.functions.frames import BLOCK, bars, holds, over_zero, rolling, series, so_far


def add_sma(df: DataFrame, period: int = 20, col: str = "close", name: str | None = None) -> DataFrame:
    return in_blocks(df, lambda d: d.withColumn(name or f"sma{period}", rolling(F.avg, F.col(col), bars(), period)), period - 1)


def add_emas(df: DataFrame, periods: dict[str, int], col: str = "close") -> DataFrame:
    """Recursive means seeded with the first value, a column per name, all in one pass."""
    alphas = {name: 2.0 / (p + 1) for name, p in periods.items()}

    def body(d: DataFrame) -> DataFrame:
        first = (F.first("bar_idx").over(so_far(bars())) == 0) & (F.count(col).over(so_far(bars())) == 1)  # of the series, where a block reaches back to it
        d = d.withColumn("__first", first)
        return decayed(d, {n: (1.0 - a, F.when(F.col("__first"), F.col(col)).otherwise(a * F.col(col))) for n, a in alphas.items()}, F.col(col).isNotNull()).drop("__first")

    return in_blocks(df, body, reach(*[1.0 - a for a in alphas.values()]))


def add_ema(df: DataFrame, period: int = 20, col: str = "close", name: str | None = None) -> DataFrame:
    return add_emas(df, {name or f"ema{period}": period}, col)


def add_emas_weighted(df: DataFrame, periods: dict[str, int], col: str = "close") -> DataFrame:
    """Means with weights (1-alpha)^k over all rows so far: numerators in one pass, denominators in closed form."""
    alphas = {name: 2.0 / (p + 1) for name, p in periods.items()}
    mean = lambda name, a: F.when(F.col("bar_idx") == 0, F.col(col)).otherwise(F.col(name) * a / (1.0 - F.pow(F.lit(1.0 - a), F.col("bar_idx") + 1)))

    def body(d: DataFrame) -> DataFrame:
        d = decayed(d, {name: (1.0 - a, F.col(col)) for name, a in alphas.items()}, F.col(col).isNotNull())
        return d.withColumns({name: mean(name, a) for name, a in alphas.items()})

    return in_blocks(df, body, reach(*[1.0 - a for a in alphas.values()]))


def add_ema_weighted(df: DataFrame, period: int, col: str = "close", name: str | None = None) -> DataFrame:
    return add_emas_weighted(df, {name or f"ewma{period}": period}, col)


def _seeded(df: DataFrame, columns: dict[str, str], period: int, alpha: float, skip: int) -> DataFrame:
    """Recursive means (name: column) whose seeds are the plain means of ``period`` values after ``skip`` rows."""

    def body(d: DataFrame) -> DataFrame:
        d = d.withColumn("__t", F.col("bar_idx") + 1 - skip)
        d = d.withColumns({f"__seed_{name}": F.avg(c).over(bars().rowsBetween(-(period - 1), 0)) for name, c in columns.items()})
        value = lambda name, c: F.when(F.col("__t") == period, F.col(f"__seed_{name}")).when(F.col("__t") > period, alpha * F.col(c))
        d = d.withColumns({f"__w_{name}": value(name, c) for name, c in columns.items()})
        known = F.coalesce(*[F.col(f"__w_{name}") for name in columns]).isNotNull()
        d = decayed(d, {name: (1.0 - alpha, F.col(f"__w_{name}")) for name in columns}, known)
        return d.drop("__t", *[f"__{p}_{name}" for name in columns for p in ("seed", "w")])

    return in_blocks(df, body, reach(1.0 - alpha) + period)


def add_ema_sma_seeded(df: DataFrame, period: int, col: str = "close", name: str | None = None) -> DataFrame:
    return _seeded(df, {name or f"ema{period}_seeded": col}, period, 2.0 / (period + 1), 0)


def _moves(col: str) -> tuple[Column, Column]:
    delta = F.col(col) - F.lag(col).over(bars())
    return F.when(delta > 0, delta).otherwise(0.0), F.when(delta < 0, -delta).otherwise(0.0)


def _add_moves(df: DataFrame, col: str) -> DataFrame:
    up, down = _moves(col)
    return df.withColumn("__up", up).withColumn("__down", down)


def add_rsi(df: DataFrame, period: int = 14, col: str = "close", name: str = "rsi", fill: float | None = None) -> DataFrame:
    """RSI of plain rolling means; the first row's change counts as 0.

    Without ``fill``: 100 where only gains exist, null where neither do. With
    ``fill``: that value wherever there is no loss.
    """

    def body(df: DataFrame) -> DataFrame:
        df = _add_moves(df, col)
        up, down = rolling(F.avg, F.col("__up"), bars(), period), rolling(F.avg, F.col("__down"), bars(), period)
        df = df.withColumn("__up", up).withColumn("__down", down)
        rsi = 100 - 100 / (1 + F.col("__up") / over_zero(F.col("__down")))
        if fill is None:
            rsi = F.coalesce(rsi, F.when((F.col("__down") == 0) & (F.col("__up") > 0), 100.0))
        else:
            rsi = F.coalesce(rsi, F.lit(fill))
        return df.withColumn(name, rsi).drop("__up", "__down")

    return in_blocks(df, body, period)


def add_rsi_wilder(df: DataFrame, period: int = 14, col: str = "close", name: str = "rsi_wilder") -> DataFrame:
    """RSI of smoothed means (alpha = 1/period), from row ``period`` on; no loss: 100."""

    def body(df: DataFrame) -> DataFrame:
        df = _add_moves(df, col)
        df = _seeded(df, {"__ag": "__up", "__al": "__down"}, period, 1.0 / period, 1)
        rsi = F.when(F.col("__al") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("__ag") / over_zero(F.col("__al"))))
        return df.withColumn(name, F.when(F.col("__al").isNotNull(), rsi)).drop("__up", "__down", "__ag", "__al")

    return in_blocks(df, body, reach(1.0 - 1.0 / period) + period + 1)


def _true_range() -> Column:
    before = F.lag("close").over(bars())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def add_atr(df: DataFrame, period: int = 14, name: str = "atr") -> DataFrame:

    def body(df: DataFrame) -> DataFrame:
        df = df.withColumn("tr", _true_range())
        return df.withColumn(name, rolling(F.avg, F.col("tr"), bars(), period))

    return in_blocks(df, body, period)


def add_adx(df: DataFrame, period: int = 14, name: str = "adx") -> DataFrame:

    def body(df: DataFrame) -> DataFrame:
        up, down = F.col("high") - F.lag("high").over(bars()), F.lag("low").over(bars()) - F.col("low")
        df = df.withColumns({"__up": up, "__down": down, "__tr": _true_range()})
        plus = F.when((F.col("__up") > F.col("__down")) & (F.col("__up") > 0), F.col("__up")).otherwise(0.0)
        minus = F.when((F.col("__down") > F.col("__up")) & (F.col("__down") > 0), F.col("__down")).otherwise(0.0)
        df = df.withColumn("__plus", plus).withColumn("__minus", minus)
        span = rolling(F.sum, F.col("__tr"), bars(), period)
        df = df.withColumns({"__span": over_zero(span), "__p": rolling(F.sum, F.col("__plus"), bars(), period), "__m": rolling(F.sum, F.col("__minus"), bars(), period)})
        df = df.withColumn("plus_di", 100 * F.col("__p") / F.col("__span")).withColumn("minus_di", 100 * F.col("__m") / F.col("__span"))
        df = df.withColumn("__dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / over_zero(F.col("plus_di") + F.col("minus_di")))
        return df.withColumn(name, rolling(F.avg, F.col("__dx"), bars(), period)).drop(*[c for c in df.columns if c.startswith("__") and c != BLOCK])

    return in_blocks(df, body, 2 * period)


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close") -> DataFrame:

    def body(df: DataFrame) -> DataFrame:
        df = add_emas(df, {"__fast": fast, "__slow": slow}, col)
        return _macd(df, signal)

    return in_blocks(df, body, reach(1.0 - 2.0 / (fast + 1), 1.0 - 2.0 / (slow + 1)) + reach(1.0 - 2.0 / (signal + 1)))


def _macd(df: DataFrame, signal: int) -> DataFrame:
    df = df.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    df = add_ema(df, signal, "macd", "macd_signal")
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def add_bbands(df: DataFrame, period: int = 20, deviations: float = 2.0, col: str = "close") -> DataFrame:

    def body(df: DataFrame) -> DataFrame:
        mid, std = rolling(F.avg, F.col(col), bars(), period), rolling(F.stddev_samp, F.col(col), bars(), period)
        return df.withColumns({"bb_mid": mid, "bb_up": mid + deviations * std, "bb_low": mid - deviations * std})

    return in_blocks(df, body, period - 1)


def add_stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:

    def body(df: DataFrame) -> DataFrame:
        low, high = rolling(F.min, F.col("low"), bars(), k), rolling(F.max, F.col("high"), bars(), k)
        df = df.withColumn("stoch_k", 100 * (F.col("close") - low) / over_zero(high - low))
        return df.withColumn("stoch_d", rolling(F.avg, F.col("stoch_k"), bars(), d))

    return in_blocks(df, body, k + d - 2)


def add_vwap(df: DataFrame, name: str = "vwap") -> DataFrame:
    """Cumulative, without session resets."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = running(df, {"__pv": ("sum", typical * F.col("volume")), "__vol": ("sum", F.col("volume"))}, ["bar_idx"], bar_block())
    return df.withColumn(name, F.col("__pv") / over_zero(F.col("__vol"))).drop("__pv", "__vol")


def add_supertrend(df: DataFrame, period: int = 10, multiplier: float = 3.0, name: str = "supertrend") -> DataFrame:
    """SuperTrend, seeded with the upper band at the first row that has one.

    A band moves to its basic value where that tightens it and the close before
    was not beyond it, else it keeps its value: a running min (max) over the
    rows that qualify. The line flips between the bands with two states: it
    stays on the upper band while close <= upper, on the lower while close >=
    lower. Rows on which both states lead to one state fix it; between such
    rows every row either keeps or swaps, so parity decides. Both parts compose:
    a block hands on its extremes, then its number of swaps and the last row
    that fixed the state.
    """

    def bands(d: DataFrame) -> DataFrame:
        d = add_atr(d, period, "__atr").drop("tr")
        mid = (F.col("high") + F.col("low")) / 2
        d = d.withColumns({"__ub": mid + multiplier * F.col("__atr"), "__lb": mid - multiplier * F.col("__atr"), "__prev": F.lag("close").over(bars())})
        first = F.lag("__ub").over(bars()).isNull()
        return d.withColumns({"__up": F.when(first | ~holds(F.col("__prev") > F.col("__ub")), F.col("__ub")), "__down": F.when(first | ~holds(F.col("__prev") < F.col("__lb")), F.col("__lb")), "__seed": F.col("__ub").isNotNull() & first})

    df = in_blocks(df, bands, period + 2)
    df = running(df, {"st_upper": ("min", F.col("__up")), "st_lower": ("max", F.col("__down"))}, ["bar_idx"], bar_block())
    df = df.withColumn("st_upper", F.when(F.col("__ub").isNotNull(), F.col("st_upper"))).withColumn("st_lower", F.when(F.col("__lb").isNotNull(), F.col("st_lower")))
    from_upper, from_lower = F.col("close") <= F.col("st_upper"), ~(F.col("close") >= F.col("st_lower"))  # next state is upper
    df = df.withColumns({"__u": F.when(F.col("__seed"), True).otherwise(from_upper), "__l": F.when(F.col("__seed"), True).otherwise(from_lower), BLOCK: bar_block()})
    df = df.withColumn("__swaps", F.sum(F.when(~F.col("__u") & F.col("__l"), 1).otherwise(0)).over(so_far(bars())))
    fixed = F.when(F.col("__u") == F.col("__l"), F.struct(F.col("__u").alias("upper"), F.col("__swaps").alias("at")))
    df = df.withColumns({"__own": fixed, "__fix": F.last(fixed, ignorenulls=True).over(so_far(bars()))})
    ends = df.groupBy("symbol", BLOCK).agg(F.max("__swaps").alias("swaps"), F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col("bar_idx"))).alias("fix"))
    ends = ends.withColumn("base", F.coalesce(F.sum("swaps").over(series(("symbol",), BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.withColumn("fix", F.when(F.col("fix").isNotNull(), F.struct(F.col("fix.upper").alias("upper"), (F.col("fix.at") + F.col("base")).alias("at"))))
    df = hand_on(df, ends, {"__base": F.sum("swaps"), "__before": F.last("fix", ignorenulls=True)}, ("symbol",))
    swaps = F.col("__swaps") + F.coalesce("__base", F.lit(0))
    at = F.when(F.col("__fix").isNotNull(), F.col("__fix.at") + F.coalesce("__base", F.lit(0))).otherwise(F.col("__before.at"))
    upper = F.coalesce("__fix.upper", "__before.upper") == ((swaps - at) % 2 == 0)
    line = F.when(upper, F.col("st_upper")).otherwise(F.col("st_lower"))
    own = ("__atr", "__ub", "__lb", "__prev", "__up", "__down", "__seed", "__u", "__l", "__swaps", "__own", "__fix", "__base", "__before", BLOCK)
    return df.withColumn(name, F.when(F.col("st_upper").isNotNull(), line)).drop(*own)


def add_volume_flags(df: DataFrame, period: int = 20, factor: float = 1.5) -> DataFrame:

    def body(df: DataFrame) -> DataFrame:
        df = df.withColumn("vol_ma", rolling(F.avg, F.col("volume"), bars(), period))
        return df.withColumns(
            {
                "vol_spike": holds(F.col("volume") > factor * F.col("vol_ma")),
                "vol_high": holds(F.col("volume") > F.col("vol_ma")),
                "vol_low": holds(F.col("volume") < F.col("vol_ma")),
                "vol_color": F.when(F.col("close") > F.col("open"), "green").otherwise("red"),
            }
        )

    return in_blocks(df, body, period - 1)


def add_basic_indicators(df: DataFrame) -> DataFrame:
    """ema9, ema21, rsi14, atr14, MACD and Bollinger bands: one partitioning by symbol."""

    def body(df: DataFrame) -> DataFrame:
        df = add_bbands(add_rsi(add_atr(df, 14, "atr14"), 14, name="rsi14"))
        return _macd(add_emas(df, {"ema9": 9, "ema21": 21, "__fast": 12, "__slow": 26}), 9)

    return in_blocks(df, body, reach(1.0 - 2.0 / 27) + reach(1.0 - 2.0 / 10))


def add_swings(df: DataFrame, lookback: int = 5) -> DataFrame:

    def body(df: DataFrame) -> DataFrame:
        return df.withColumn("swing_high", rolling(F.max, F.col("high"), bars(), lookback)).withColumn("swing_low", rolling(F.min, F.col("low"), bars(), lookback))

    return in_blocks(df, body, lookback - 1)
