"""As-of, nearest-time, interval and other joins of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.blocks import bar_block, day, positions, running
from barline.operators.sweeps import mix


def asof_quotes(candles: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each candle with the latest bid and ask at or before it; null before the first quote.

    Both series in blocks of a day: what a day ends with is handed on to the next, however many days are empty.
    """
    q = quotes.select("symbol", F.col("ts").alias("datetime"), F.col("bid").alias("__bid"), F.col("ask").alias("__ask"), F.lit(0).alias("__kind"))
    both = candles.withColumn("__kind", F.lit(1)).unionByName(q, allowMissingColumns=True)
    known = running(both, {"bid": ("last", F.col("__bid")), "ask": ("last", F.col("__ask"))}, ["datetime", "__kind"], day("datetime"))
    return known.filter("__kind = 1").drop("__kind", "__bid", "__ask")


def nearest(events: DataFrame, candles: DataFrame, time: str = "ts") -> DataFrame:
    """Each event with the nearest candle's time; of two as near, the earlier. Blocks as in ``asof_quotes``, in both directions."""
    e = events.withColumns({"__t": F.col(time), "__kind": F.lit(1), "__c": F.lit(None).cast(dict(candles.dtypes)["datetime"])})
    c = candles.select("symbol", F.col("datetime").alias("__t"), F.lit(0).alias("__kind"), F.col("datetime").alias("__c"))
    both = e.unionByName(c, allowMissingColumns=True)
    order = ["__t", "__kind"]
    both = running(both, {"__b": ("last", F.col("__c"))}, order, day("__t"))
    both = running(both, {"__a": ("last", F.col("__c"))}, order, day("__t"), backwards=True).filter("__kind = 1")
    gap = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    chosen = F.when(F.col("__a").isNull() | (gap(F.col("__b"), F.col("__t")) <= gap(F.col("__t"), F.col("__a"))), F.col("__b")).otherwise(F.col("__a"))
    return both.withColumn("nearest", F.coalesce(chosen, "__a")).drop("__t", "__kind", "__c", "__a", "__b")


def bars_around(trades: DataFrame, candles: DataFrame, window: int = 200, least: int = 30, bucket: int = 256) -> DataFrame:
    """Bars within pad = max((window - bars in trade) div 2, least) of each trade, by bucket equi-join."""
    pad = F.greatest(F.floor((F.lit(window) - F.col("bars_in_trade")) / 2), F.lit(least))
    t = trades.select("symbol", "id", (F.col("entry_bar_index") - pad).alias("lo"), (F.col("exit_bar_index") + pad).alias("hi"))
    t = t.withColumn("bucket", F.explode(F.sequence(F.floor(F.greatest(F.col("lo"), F.lit(0)) / bucket), F.floor(F.col("hi") / bucket))))
    c = candles.withColumn("bucket", F.floor(F.col("bar_idx") / bucket))
    return t.join(c, ["symbol", "bucket"]).filter(F.col("bar_idx").between(F.col("lo"), F.col("hi"))).drop("bucket", "lo", "hi")


def mark_to_market(positions: DataFrame, candles: DataFrame) -> DataFrame:
    """Open positions at the latest close: last_price, open_pnl, equity."""
    last = candles.groupBy("symbol").agg(F.max_by("close", "datetime").alias("last_price"))
    sign = F.when(F.lower("side").isin("buy", "long"), 1).otherwise(-1)
    pnl = (F.col("last_price") - F.col("entry_price")) * F.col("quantity") * sign
    return positions.join(last, "symbol", "left").withColumn("open_pnl", pnl).withColumn("equity", F.col("balance") + F.coalesce("open_pnl", F.lit(0.0)))


def reconcile(positions: DataFrame, candles: DataFrame) -> DataFrame:
    """Positions whose stop or target the latest price has passed: closed there, with a reason."""
    p = mark_to_market(positions, candles)
    long = F.lower("side").isin("buy", "long")
    sl = F.when(long, F.col("last_price") <= F.col("stop_loss")).otherwise(F.col("last_price") >= F.col("stop_loss"))
    tp = F.when(long, F.col("last_price") >= F.col("take_profit")).otherwise(F.col("last_price") <= F.col("take_profit"))
    p = p.withColumn("reason", F.when(sl, "Recovered SL").when(tp, "Recovered TP")).filter("reason is not null")
    return p.withColumn("exit_price", F.when(F.col("reason") == "Recovered SL", F.col("stop_loss")).otherwise(F.col("take_profit"))).drop("open_pnl", "equity")


def next_unseen(trades: DataFrame, seen: DataFrame, seed: int = 7) -> DataFrame:
    """One pseudorandom trade per symbol that is not in ``seen``; where all were seen, of all."""
    fresh = trades.join(seen.select("symbol", "id"), ["symbol", "id"], "left_anti")
    again = trades.join(fresh.select("symbol").distinct(), "symbol", "left_anti")
    order = F.row_number().over(Window.partitionBy("symbol").orderBy(mix(F.lit(seed), F.col("id")), "id"))
    return fresh.unionByName(again).withColumn("__n", order).filter("__n = 1").drop("__n")


def zip_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str, keys=("symbol",)) -> DataFrame:
    """Row k of one side with row k of the other; the orders are numbers that about count rows."""
    number = lambda df, order: positions(df, "position", [order], bar_block(order), keys)
    return number(left, left_order).join(number(right, right_order), [*keys, "position"])
