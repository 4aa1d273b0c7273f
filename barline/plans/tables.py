"""The given event table as ticks, candles, quotes, signals and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators import candles as C
from barline.operators import ledger, signals


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"), "event_id")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_bar_idx(C.from_ticks(ticks(spark, sf_dir)))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote around every tick."""
    t = ticks(spark, sf_dir)
    return t.select("symbol", "ts", (F.col("price") * (1 - F.col("qty") / 10000)).alias("bid"), (F.col("price") * (1 + F.col("qty") / 10000)).alias("ask"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of three levels a side around each tick."""
    t = ticks(spark, sf_dir)

    def side(sign: int):
        return F.array(*[F.array((F.col("price") * (1 + sign * F.lit(float(k)) / 1000)).cast("string"), (F.col("qty") * (4 - k) + 1).cast("string")) for k in (1, 2, 3)])

    return t.select("symbol", F.col("ts").alias("snapshot_ts"), side(-1).alias("bids"), side(1).alias("asks"))


def trades(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The single-position ledger of the moving-average and RSI signals."""
    return ledger.single_position_ledger(ma_rsi(spark, sf_dir), **options)


def ma_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving-average and RSI signals with a stop of 5 % and a target of 10 %."""
    s = signals.ma_rsi_signals(candles(spark, sf_dir))
    return s.withColumns({"stop_price": F.col("close") * (1 - 0.05 * F.col("signal")), "take_price": F.col("close") * (1 + 0.10 * F.col("signal"))})


# --- the same in SQL -------------------------------------------------------------

TICKS = "t AS (SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, event_id FROM events)"
CANDLES = f"""{TICKS},
c0 AS (SELECT symbol, time_bucket(INTERVAL 15 minutes, ts) AS datetime, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(qty) AS volume FROM t GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS bar_idx FROM c0)"""
MOVES = f"""{CANDLES},
mv AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS delta FROM c),
ud AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0.0::DOUBLE END AS up, CASE WHEN delta < 0 THEN -delta ELSE 0.0::DOUBLE END AS down FROM mv)"""


def rolled(agg: str, col: str, n: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {frame} = {n} THEN {agg}({col}) {frame} END"


RSI = f"""{MOVES},
ra AS (SELECT *, {rolled("avg", "up", 14)} AS au, {rolled("avg", "down", 14)} AS ad FROM ud)"""
MA_RSI = f"""{RSI},
ma AS (SELECT *, {rolled("avg", "close", 9)} AS ms, {rolled("avg", "close", 21)} AS ml, coalesce(100 - 100 / (1 + au / nullif(ad, 0)), 50.0::DOUBLE) AS rsi FROM ra),
s AS (SELECT *, CASE WHEN ms > ml AND rsi > 55 THEN 1 WHEN ms < ml AND rsi < 45 THEN -1 ELSE 0 END AS signal FROM ma)"""
# One trade per signal: its bars follow the entry up to the next signal.
TRADES = f"""{MA_RSI},
n AS (SELECT *, coalesce(sum(CASE WHEN signal <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM s),
e AS (SELECT symbol, n AS id, signal AS dir, bar_idx AS eb, datetime AS et, close AS ep, close * (1 - 0.05::DOUBLE * signal) AS sp, close * (1 + 0.10::DOUBLE * signal) AS tp, volume AS vol FROM n WHERE signal <> 0),
b AS (SELECT e.*, n.bar_idx, n.datetime, n.high, n.low, n.close, n.signal,
        CASE WHEN (dir > 0 AND n.low <= sp) OR (dir < 0 AND n.high >= sp) THEN 'sl' WHEN (dir > 0 AND n.high >= tp) OR (dir < 0 AND n.low <= tp) THEN 'tp' END AS reason
      FROM e JOIN n ON e.symbol = n.symbol AND n.n = e.id + 1),
l AS (SELECT *, count(reason) OVER (PARTITION BY symbol, id ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM b),
x AS (SELECT symbol, id, max(bar_idx) AS xb, arg_max(datetime, bar_idx) AS xt, arg_max(coalesce(reason, CASE WHEN signal <> 0 THEN 'signal' ELSE 'eod' END), bar_idx) AS xr,
        arg_max(CASE reason WHEN 'sl' THEN sp WHEN 'tp' THEN tp ELSE close END, bar_idx) AS xp, max(high) AS top, min(low) AS bottom FROM l WHERE done = 0 GROUP BY 1, 2),
tr AS (SELECT e.symbol, CAST(e.id AS BIGINT) AS id, CASE WHEN dir > 0 THEN 'long' ELSE 'short' END AS direction, et AS entry_time, eb AS entry_bar_index, ep AS entry_price, vol AS volume_at_entry,
        coalesce(xt, et) AS exit_time, coalesce(xb, eb) AS exit_bar_index, coalesce(xp, ep) AS exit_price, coalesce(xr, 'eod') AS exit_reason, (coalesce(xp, ep) - ep) * dir + 0.0::DOUBLE AS pnl,
        greatest(coalesce(CASE WHEN dir > 0 THEN top - ep ELSE ep - bottom END, 0), 0) AS max_favor, least(coalesce(CASE WHEN dir > 0 THEN bottom - ep ELSE ep - top END, 0), 0) AS max_adverse, abs(ep - sp) AS risk
      FROM e LEFT JOIN x USING (symbol, id))"""
EQUITY = f"""{TRADES},
q0 AS (SELECT *, 1000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY exit_time, id ROWS UNBOUNDED PRECEDING) AS equity FROM tr),
q1 AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY exit_time, id ROWS UNBOUNDED PRECEDING) AS peak FROM q0),
q AS (SELECT *, equity / peak - 1 AS drawdown, equity - peak AS dd_value FROM q1)"""
