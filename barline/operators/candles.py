"""Candles: from klines and ticks; order, gaps, duplicates, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.frames import series

# Minutes of a unit; open times outside these bounds are dropped.
UNIT_MINUTES = {"m": 1, "h": 60, "d": 1440}
OPEN_TIME_BOUNDS = (0, 32503680000000)


def normalize_timeframe(tf: str) -> str:
    """"1H", "h1" and " 1h " become "1h"."""
    tf = tf.strip().lower()
    return tf[1:] + tf[0] if tf[:1] in UNIT_MINUTES and tf[1:].isdigit() else tf


def timeframe_minutes(tf: Column) -> Column:
    """Minutes of a time frame text; unknown ones count 60."""
    t = F.lower(F.trim(tf))
    number = F.regexp_extract(t, r"(\d+)", 1)
    unit = F.regexp_extract(t, r"^(?:\d+([mhd])|([mhd])\d+)$", 1)
    unit = F.when(unit == "", F.regexp_extract(t, r"^([mhd])\d+$", 1)).otherwise(unit)
    per = F.create_map(*[F.lit(x) for pair in UNIT_MINUTES.items() for x in pair])
    minutes = F.try_element_at(per, unit) * number.try_cast("int")
    return F.coalesce(minutes, F.lit(60))


def from_klines(klines: DataFrame, symbol: Column) -> DataFrame:
    """Typed candles from the 12 exchange fields; absurd open times are dropped."""
    lo, hi = OPEN_TIME_BOUNDS
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return klines.filter((F.col("open_time") > lo) & (F.col("open_time") < hi)).select(symbol.alias("symbol"), F.timestamp_millis("open_time").alias("datetime"), *prices)


def tick_aggregates(ticks: DataFrame) -> list[Column]:
    """Open, high, low, close and volume of a group of ticks."""
    at = F.struct("ts", "event_id" if "event_id" in ticks.columns else "price")
    return [F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume")]


def from_ticks(ticks: DataFrame, timeframe: str = "15 minutes") -> DataFrame:
    """Bars of (symbol, ts, price, qty), one shuffle with map-side partial aggregates.

    Of ticks at one time the one with the smaller ``event_id`` comes first, or
    without that column the one with the smaller price.
    """
    bars = ticks.groupBy("symbol", F.window("ts", timeframe).alias("w")).agg(*tick_aggregates(ticks))
    return bars.select("symbol", F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume")


def with_bar_idx(candles: DataFrame, keys=("symbol",)) -> DataFrame:
    return candles.withColumn("bar_idx", (F.row_number().over(series(keys)) - 1).cast("long"))


def between(candles: DataFrame, start, end) -> DataFrame:
    return candles.filter(F.col("datetime").between(F.lit(start), F.lit(end)))


def drop_forming(candles: DataFrame) -> DataFrame:
    """Without the last bar of each series, which is still forming."""
    return candles.withColumn("__last", F.max("datetime").over(Window.partitionBy("symbol"))).filter("datetime < __last").drop("__last")


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe(candles: DataFrame, ingest: str = "ingest_seq") -> DataFrame:
    """The first arrival of each (symbol, datetime)."""
    w = Window.partitionBy("symbol", "datetime").orderBy(ingest)
    return candles.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(rows: DataFrame, changes: DataFrame, keys=("symbol", "datetime"), seq: str = "update_seq") -> DataFrame:
    """The last write of each key wins; candles without a valid time are dropped by the caller."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return concat(rows, changes).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def gaps(candles: DataFrame, minutes: int) -> DataFrame:
    """(symbol, t1, t2, delta_s) where the next bar is later than the time frame."""
    t2 = F.lead("datetime").over(series())
    delta = F.timestamp_diff("SECOND", F.col("t1"), F.col("t2"))
    return candles.select("symbol", F.col("datetime").alias("t1"), t2.alias("t2")).withColumn("delta_s", delta).filter(F.col("delta_s") > minutes * 60)


def direction(open_: Column, close: Column) -> Column:
    return F.when(close > open_, "green").otherwise("red")
