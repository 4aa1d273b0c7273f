"""Readers: kline archives, trade ledgers, message streams. Schemas are always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.candles import from_klines
from barline.schemas import KLINE, LIVE_LEDGER, MESSAGE


def read_kline_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Candles from headerless monthly files in a .../<symbol>/<timeframe>/ layout.

    All files are one scan; symbol and timeframe come from the path.
    """
    raw = spark.read.schema(KLINE).csv(paths)
    parts = F.split(F.input_file_name(), "/")
    raw = raw.withColumn("timeframe", F.element_at(parts, -2)).withColumn("__symbol", F.element_at(parts, -3))
    return from_klines(raw, F.col("__symbol"))


def read_ohlcv(spark: SparkSession, path: str, symbol: str, start=None, end=None, fmt: str = "csv") -> DataFrame:
    """Candles of one symbol in [start, end], from csv, json or parquet klines."""
    candles = from_klines(spark.read.schema(KLINE).format(fmt).load(path), F.lit(symbol))
    if start is not None:
        candles = candles.filter(F.col("datetime") >= F.lit(start))
    return candles if end is None else candles.filter(F.col("datetime") <= F.lit(end))


def read_live_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The 15-column trade ledger as text; cells are cast where they are used, so bad ones become null."""
    return spark.read.schema(LIVE_LEDGER).option("header", True).csv(path)


def read_messages(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Exchange messages, one JSON text a row, from landed files (see ``parse_messages`` for Kafka values)."""
    source = spark.readStream if stream else spark.read
    return parse_messages(source.schema("value string").text(path))


def parse_messages(raw: DataFrame, value: str | Column = "value") -> DataFrame:
    """Parsed envelopes with ``type``; malformed messages and those without a type are dropped."""
    text = F.col(value) if isinstance(value, str) else value
    text = text.cast("string")
    event = F.coalesce(F.get_json_object(text, "$.data.E"), F.get_json_object(text, "$.E")).try_cast("long")  # e and E would clash as columns
    m = raw.select(F.from_json(text, MESSAGE).alias("m"), event.alias("event_ms"))
    return m.select("m.*", "event_ms").withColumn("type", F.coalesce("data.e", "e")).withColumn("symbol", F.coalesce("data.s", "s")).filter("type is not null")


def klines(messages: DataFrame) -> DataFrame:
    """Live candle events; a kline message without its body is dropped."""
    k = messages.filter("type = 'kline' and data.k is not null")
    number = lambda n: F.col(f"data.k.{n}").try_cast("double")
    return k.select("symbol", F.timestamp_millis("data.k.t").alias("datetime"), number("o").alias("open"), number("h").alias("high"), number("l").alias("low"), number("c").alias("close"), number("v").alias("volume"), F.col("data.k.x").alias("is_closed"), F.timestamp_millis("event_ms").alias("event_time"))


def quotes(messages: DataFrame) -> DataFrame:
    q = messages.filter("type = 'bookTicker'")
    return q.select("symbol", F.timestamp_millis("event_ms").alias("ts"), F.col("data.b").try_cast("double").alias("bid"), F.col("data.a").try_cast("double").alias("ask"))


def prints(messages: DataFrame) -> DataFrame:
    p = messages.filter("type = 'aggTrade'")
    return p.select("symbol", F.timestamp_millis("data.T").alias("ts"), F.col("data.p").try_cast("double").alias("price"), F.col("data.q").try_cast("double").alias("qty"))


def books(messages: DataFrame) -> DataFrame:
    b = messages.filter("type = 'depthUpdate'")
    return b.select("symbol", F.timestamp_millis("event_ms").alias("snapshot_ts"), F.col("b").alias("bids"), F.col("a").alias("asks"))
