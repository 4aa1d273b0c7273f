"""Queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions import formatting
from barline.operators import candles as C
from barline.operators import indicators as I
from barline.operators import joins, ledger, metrics, orderbook, patterns, quality, signals, sweeps
from barline.plans import tables as T
from barline.plans.tables import CANDLES, EQUITY, MA_RSI, MOVES, RSI, TICKS, TRADES, rolled

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Floating columns to 6 digits without negative zeros, and the listed columns if any."""
    doubles = {n for n, t in df.dtypes if t in ("double", "float")}
    names = columns or df.columns
    return df.select(*[((F.round(n, 6) + 0.0).alias(n) if n in doubles else F.col(n)) for n in names])


def _mix_sql(*parts: str) -> str:
    x = "17::BIGINT"
    for p in parts:
        x = f"((({x} * 1103515245 + {p} + 12345) % 2147483648) * 69069 + 1) % 2147483648"
    return x


KEY = ("symbol", "bar_idx")


@query(f"""WITH {MA_RSI},
a AS (SELECT symbol, bar_idx, signal, close, row_number() OVER w AS k, lead(close) OVER w AS nx FROM s WHERE signal <> 0 WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
p AS (SELECT symbol, CASE WHEN signal > 0 THEN nx - close ELSE close - nx END AS pnl FROM a WHERE k % 2 = 1 AND nx IS NOT NULL),
g AS (SELECT symbol, sum(pnl) AS pnl, count(*) FILTER (WHERE pnl > 0) AS w, count(*) AS n FROM p GROUP BY 1)
SELECT u.symbol, round(1000 + coalesce(pnl, 0), 6) AS equity_final, round(coalesce(pnl, 0.0), 6) AS pnl, round(coalesce(w / n, 0.0), 6) AS win_rate FROM (SELECT DISTINCT symbol FROM c) u LEFT JOIN g USING (symbol)""")
def ma_rsi_pairing(spark, d):
    return r6(ledger.pairing_summary(signals.ma_rsi_signals(T.candles(spark, d))))


@query(f"WITH {CANDLES} SELECT symbol, datetime, bar_idx, open, high, low, close, volume FROM c")
def ticks_to_bars(spark, d):
    return T.candles(spark, d).select("symbol", "datetime", "bar_idx", "open", "high", "low", "close", "volume")


@query(f"""WITH {CANDLES}, g AS (SELECT symbol, datetime AS t1, lead(datetime) OVER (PARTITION BY symbol ORDER BY datetime) AS t2 FROM c)
SELECT symbol, t1, t2, CAST(date_diff('second', t1, t2) AS BIGINT) AS delta_s FROM g WHERE date_diff('second', t1, t2) > 900""")
def candle_gaps(spark, d):
    return C.gaps(T.candles(spark, d), 15)


@query(f"""WITH {TICKS}, k AS (SELECT symbol, time_bucket(INTERVAL 15 minutes, ts) AS datetime, price, event_id FROM t)
SELECT symbol, datetime, arg_min(price, event_id) AS price, min(event_id) AS ingest_seq FROM k GROUP BY 1, 2""")
def dedupe_first_arrival(spark, d):
    t = T.ticks(spark, d).select("symbol", F.window("ts", "15 minutes").start.alias("datetime"), "price", F.col("event_id").alias("ingest_seq"))
    return C.dedupe(t)


@query(f"""WITH {TICKS}, k AS (SELECT symbol, time_bucket(INTERVAL 1 hour, ts) AS datetime, price, event_id FROM t)
SELECT symbol, datetime, arg_max(price, event_id) AS price, max(event_id) AS update_seq FROM k GROUP BY 1, 2""")
def upsert_last_write(spark, d):
    t = T.ticks(spark, d).select("symbol", F.window("ts", "1 hour").start.alias("datetime"), "price", F.col("event_id").alias("update_seq"))
    return C.upsert(t.filter("update_seq % 2 = 0"), t.filter("update_seq % 2 = 1"))


@query(f"WITH {CANDLES}, m AS (SELECT *, max(datetime) OVER (PARTITION BY symbol) AS m FROM c) SELECT symbol, datetime, close, CASE WHEN close > open THEN 'green' ELSE 'red' END AS color FROM m WHERE datetime < m")
def drop_forming_bar(spark, d):
    return C.drop_forming(T.candles(spark, d)).select("symbol", "datetime", "close", C.direction(F.col("open"), F.col("close")).alias("color"))


@query("""WITH t AS (SELECT event_id, concat(CAST(event_id % 7 AS VARCHAR), CASE event_id % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'H' WHEN 2 THEN 'd' ELSE 'w' END) AS tf FROM events)
SELECT event_id, tf, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 7 WHEN 1 THEN 60 * (event_id % 7) WHEN 2 THEN 1440 * (event_id % 7) ELSE 60 END AS BIGINT) AS minutes FROM t""")
def timeframe_minutes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    unit = F.get(F.array(*[F.lit(u) for u in "mHdw"]), (F.col("event_id") % 4).cast("int"))
    e = e.select("event_id", F.concat((F.col("event_id") % 7).cast("string"), unit).alias("tf"))
    return e.withColumn("minutes", C.timeframe_minutes(F.col("tf")).cast("long"))


def _dirty(spark, d):
    """Candles in which some rows break the rules."""
    c = T.candles(spark, d)
    k = F.col("bar_idx") % 97
    return c.withColumns({"high": F.when(k == 3, F.col("low") - 1).otherwise(F.col("high")), "open": F.when(k == 5, -F.col("open")).otherwise(F.col("open")), "volume": F.when(k == 7, 0.0).otherwise(F.col("volume"))})


DIRTY = f"""{CANDLES},
d AS (SELECT symbol, datetime, bar_idx, CASE WHEN bar_idx % 97 = 5 THEN -open ELSE open END AS open, CASE WHEN bar_idx % 97 = 3 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN bar_idx % 97 = 7 THEN 0.0::DOUBLE ELSE volume END AS volume FROM c),
i AS (SELECT symbol, datetime, 'outside_range' AS issue FROM d WHERE NOT (low <= open AND open <= high AND low <= close AND close <= high)
      UNION ALL SELECT symbol, datetime, 'not_positive' FROM d WHERE NOT (open > 0 AND high > 0 AND low > 0 AND close > 0)
      UNION ALL SELECT symbol, datetime, 'high_below_low' FROM d WHERE NOT high >= low),
p AS (SELECT symbol, datetime, (high - low) / nullif(open, 0) AS range_pct FROM d WHERE (high - low) / nullif(open, 0) > 0.20),
lim AS (SELECT symbol, avg(volume) + 5 * stddev_samp(volume) AS lim FROM d GROUP BY 1),
v AS (SELECT symbol, datetime, volume, 'zero' AS issue FROM d WHERE volume = 0 UNION ALL SELECT symbol, datetime, volume, 'spike' FROM d JOIN lim USING (symbol) WHERE volume > lim)"""


@query(f"WITH {DIRTY} SELECT * FROM i")
def candle_integrity(spark, d):
    return quality.integrity_issues(_dirty(spark, d))


@query(f"WITH {DIRTY} SELECT symbol, datetime, round(range_pct, 6) AS range_pct FROM p")
def price_spikes(spark, d):
    return r6(quality.price_spikes(_dirty(spark, d)))


@query(f"WITH {DIRTY} SELECT * FROM v")
def volume_anomalies(spark, d):
    return quality.volume_anomalies(_dirty(spark, d))


@query(f"""WITH {DIRTY}, g AS (SELECT symbol, count(*) FILTER (WHERE date_diff('second', p, datetime) > 900) AS gaps FROM (SELECT symbol, datetime, lag(datetime) OVER (PARTITION BY symbol ORDER BY datetime) AS p FROM d) GROUP BY 1),
n AS (SELECT symbol, gaps, 0::BIGINT AS duplicates, 0::BIGINT AS out_of_order, (SELECT count(*) FROM i WHERE i.symbol = g.symbol) AS invalid, (SELECT count(*) FROM p WHERE p.symbol = g.symbol) AS price_spikes, (SELECT count(*) FROM v WHERE v.symbol = g.symbol) AS volume_anomalies FROM g),
s AS (SELECT *, CAST(greatest(0, 100 - 2 * gaps - 2 * duplicates - 3 * out_of_order - 4 * invalid - price_spikes - volume_anomalies) AS BIGINT) AS score FROM n)
SELECT *, CASE WHEN score >= 95 THEN 'excellent' WHEN score >= 85 THEN 'very good' WHEN score >= 70 THEN 'fair' ELSE 'poor' END AS label FROM s""")
def quality_report(spark, d):
    return quality.report(_dirty(spark, d), 15)


@query(f"WITH {CANDLES} SELECT symbol, bar_idx, round({rolled('avg', 'close', 20)}, 6) AS sma20, round({rolled('max', 'high', 5)}, 6) AS swing_high, round({rolled('min', 'low', 5)}, 6) AS swing_low FROM c")
def sma_and_swings(spark, d):
    return r6(I.add_swings(I.add_sma(T.candles(spark, d))), *KEY, "sma20", "swing_high", "swing_low")


def _ema_sql(alpha: str, seed_rank: int = 1) -> str:
    return f"""WITH RECURSIVE {CANDLES}, e AS (SELECT symbol, bar_idx, close AS y FROM c WHERE bar_idx = 0
UNION ALL SELECT c.symbol, c.bar_idx, {alpha} * c.close + (1 - {alpha}) * e.y FROM e JOIN c ON c.symbol = e.symbol AND c.bar_idx = e.bar_idx + 1)"""


@query(_ema_sql("(2.0::DOUBLE / 22)") + " SELECT symbol, bar_idx, round(y, 6) AS ema21 FROM e")
def ema(spark, d):
    return r6(I.add_ema(T.candles(spark, d), 21), *KEY, "ema21")


@query(f"""WITH RECURSIVE {CANDLES}, e AS (SELECT symbol, bar_idx, close AS num, 1.0::DOUBLE AS den FROM c WHERE bar_idx = 0
UNION ALL SELECT c.symbol, c.bar_idx, c.close + (1 - 2.0::DOUBLE / 22) * e.num, 1 + (1 - 2.0::DOUBLE / 22) * e.den FROM e JOIN c ON c.symbol = e.symbol AND c.bar_idx = e.bar_idx + 1)
SELECT symbol, bar_idx, round(num / den, 6) AS ewma21 FROM e""")
def ema_weighted(spark, d):
    return r6(I.add_ema_weighted(T.candles(spark, d), 21), *KEY, "ewma21")


@query(f"""WITH RECURSIVE {CANDLES}, e AS (SELECT symbol, 19::BIGINT AS bar_idx, avg(close) AS y FROM c WHERE bar_idx < 20 GROUP BY 1
UNION ALL SELECT c.symbol, c.bar_idx, 2.0::DOUBLE / 21 * c.close + (1 - 2.0::DOUBLE / 21) * e.y FROM e JOIN c ON c.symbol = e.symbol AND c.bar_idx = e.bar_idx + 1)
SELECT c.symbol, c.bar_idx, round(y, 6) AS ema20_seeded FROM c LEFT JOIN e USING (symbol, bar_idx)""")
def ema_sma_seeded(spark, d):
    return r6(I.add_ema_sma_seeded(T.candles(spark, d), 20), *KEY, "ema20_seeded")


@query(f"WITH {RSI} SELECT symbol, bar_idx, round(coalesce(100 - 100 / (1 + au / nullif(ad, 0)), CASE WHEN ad = 0 AND au > 0 THEN 100 END), 6) AS rsi, round(coalesce(100 - 100 / (1 + au / nullif(ad, 0)), 50), 6) AS rsi_filled FROM ra")
def rsi(spark, d):
    return r6(I.add_rsi(I.add_rsi(T.candles(spark, d)), name="rsi_filled", fill=50.0), *KEY, "rsi", "rsi_filled")


@query(f"""WITH RECURSIVE {MOVES}, e AS (SELECT symbol, 14::BIGINT AS bar_idx, avg(up) AS g, avg(down) AS l FROM ud WHERE bar_idx BETWEEN 1 AND 14 GROUP BY 1
UNION ALL SELECT u.symbol, u.bar_idx, (13 * e.g + u.up) / 14, (13 * e.l + u.down) / 14 FROM e JOIN ud u ON u.symbol = e.symbol AND u.bar_idx = e.bar_idx + 1)
SELECT c.symbol, c.bar_idx, round(CASE WHEN l IS NULL THEN NULL WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi_wilder FROM c LEFT JOIN e USING (symbol, bar_idx)""")
def rsi_wilder(spark, d):
    return r6(I.add_rsi_wilder(T.candles(spark, d)), *KEY, "rsi_wilder")


TR = f"""{CANDLES}, pc AS (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM pc)"""


@query(f"WITH {TR} SELECT symbol, bar_idx, round(tr, 6) AS tr, round({rolled('avg', 'tr', 14)}, 6) AS atr FROM tr")
def atr(spark, d):
    return r6(I.add_atr(T.candles(spark, d)), *KEY, "tr", "atr")


@query(f"""WITH {TR}, dm AS (SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0::DOUBLE END AS p, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0::DOUBLE END AS m FROM tr),
sm AS (SELECT *, {rolled('sum', 'tr', 14)} AS t, {rolled('sum', 'p', 14)} AS sp, {rolled('sum', 'm', 14)} AS sn FROM dm),
di AS (SELECT *, 100 * sp / nullif(t, 0) AS pdi, 100 * sn / nullif(t, 0) AS mdi FROM sm),
dx AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di)
SELECT symbol, bar_idx, round(pdi, 6) AS plus_di, round(mdi, 6) AS minus_di, round({rolled('avg', 'dx', 14)}, 6) AS adx FROM dx""")
def adx(spark, d):
    return r6(I.add_adx(T.candles(spark, d)), *KEY, "plus_di", "minus_di", "adx")


@query(f"""WITH RECURSIVE {CANDLES}, e AS (SELECT symbol, bar_idx, close AS f, close AS s, 0.0::DOUBLE AS g FROM c WHERE bar_idx = 0
UNION ALL SELECT c.symbol, c.bar_idx, 2.0::DOUBLE / 13 * c.close + 11.0::DOUBLE / 13 * e.f, 2.0::DOUBLE / 27 * c.close + 25.0::DOUBLE / 27 * e.s,
  0.2::DOUBLE * ((2.0::DOUBLE / 13 * c.close + 11.0::DOUBLE / 13 * e.f) - (2.0::DOUBLE / 27 * c.close + 25.0::DOUBLE / 27 * e.s)) + 0.8::DOUBLE * e.g
FROM e JOIN c ON c.symbol = e.symbol AND c.bar_idx = e.bar_idx + 1)
SELECT symbol, bar_idx, round(f - s, 6) AS macd, round(g, 6) AS macd_signal, round(f - s - g, 6) AS macd_hist FROM e""")
def macd(spark, d):
    return r6(I.add_macd(T.candles(spark, d)), *KEY, "macd", "macd_signal", "macd_hist")


@query(f"""WITH {CANDLES}, m AS (SELECT symbol, bar_idx, {rolled('avg', 'close', 20)} AS m, {rolled('stddev_samp', 'close', 20)} AS s FROM c)
SELECT symbol, bar_idx, round(m, 6) AS bb_mid, round(m + 2 * s, 6) AS bb_up, round(m - 2 * s, 6) AS bb_low FROM m""")
def bbands(spark, d):
    return r6(I.add_bbands(T.candles(spark, d)), *KEY, "bb_mid", "bb_up", "bb_low")


@query(f"""WITH {CANDLES}, k AS (SELECT *, {rolled('min', 'low', 14)} AS lo, {rolled('max', 'high', 14)} AS hi FROM c), k2 AS (SELECT symbol, bar_idx, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM k)
SELECT symbol, bar_idx, round(k, 6) AS stoch_k, round({rolled('avg', 'k', 3)}, 6) AS stoch_d FROM k2""")
def stochastic(spark, d):
    return r6(I.add_stochastic(T.candles(spark, d)), *KEY, "stoch_k", "stoch_d")


@query(f"WITH {CANDLES} SELECT symbol, bar_idx, round(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) AS vwap FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)")
def vwap(spark, d):
    return r6(I.add_vwap(T.candles(spark, d)), *KEY, "vwap")


@query(f"""WITH RECURSIVE {TR}, a AS (SELECT *, {rolled('avg', 'tr', 10)} AS atr FROM tr), bd AS (SELECT *, (high + low) / 2 + 3 * atr AS ub, (high + low) / 2 - 3 * atr AS lb FROM a),
e AS (SELECT symbol, bar_idx, ub AS u, lb AS l, true AS up, close FROM bd WHERE bar_idx = 9
UNION ALL SELECT symbol, bar_idx, u, l, CASE WHEN was THEN close <= u ELSE NOT close >= l END, close FROM (
  SELECT b.symbol, b.bar_idx, b.close, e.up AS was, CASE WHEN b.ub > e.u OR e.close > b.ub THEN e.u ELSE b.ub END AS u, CASE WHEN b.lb < e.l OR e.close < b.lb THEN e.l ELSE b.lb END AS l
  FROM e JOIN bd b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 1) z)
SELECT c.symbol, c.bar_idx, round(u, 6) AS st_upper, round(l, 6) AS st_lower, round(CASE WHEN up THEN u ELSE l END, 6) AS supertrend FROM c LEFT JOIN e USING (symbol, bar_idx)""")
def supertrend(spark, d):
    return r6(I.add_supertrend(T.candles(spark, d)), *KEY, "st_upper", "st_lower", "supertrend")


@query(f"""WITH {CANDLES}, m AS (SELECT *, {rolled('avg', 'volume', 20)} AS vm FROM c)
SELECT symbol, bar_idx, round(vm, 6) AS vol_ma, coalesce(volume > 1.5::DOUBLE * vm, false) AS vol_spike, coalesce(volume > vm, false) AS vol_high, coalesce(volume < vm, false) AS vol_low, CASE WHEN close > open THEN 'green' ELSE 'red' END AS vol_color FROM m""")
def volume_flags(spark, d):
    return r6(I.add_volume_flags(T.candles(spark, d)), *KEY, "vol_ma", "vol_spike", "vol_high", "vol_low", "vol_color")


@query(f"""WITH RECURSIVE {RSI}, x AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM ra WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
e AS (SELECT symbol, bar_idx, close AS y9, close AS y21 FROM c WHERE bar_idx = 0
UNION ALL SELECT c.symbol, c.bar_idx, 0.2::DOUBLE * c.close + 0.8::DOUBLE * e.y9, 2.0::DOUBLE / 22 * c.close + 20.0::DOUBLE / 22 * e.y21 FROM e JOIN c ON c.symbol = e.symbol AND c.bar_idx = e.bar_idx + 1)
SELECT symbol, bar_idx, round(y9, 6) AS ema9, round(y21, 6) AS ema21, round(coalesce(100 - 100 / (1 + au / nullif(ad, 0)), CASE WHEN ad = 0 AND au > 0 THEN 100 END), 6) AS rsi14, round({rolled('avg', 'tr', 14)}, 6) AS atr14, round({rolled('avg', 'close', 20)}, 6) AS bb_mid FROM x JOIN e USING (symbol, bar_idx)""")
def basic_indicators(spark, d):
    return r6(I.add_basic_indicators(T.candles(spark, d)), *KEY, "ema9", "ema21", "rsi14", "atr14", "bb_mid")


GAPS = f"""{CANDLES}, k AS (SELECT *, lag(high, 2) OVER w AS h0, lag(high) OVER w AS h1, lag(low, 2) OVER w AS l0, lag(low) OVER w AS l1, max(bar_idx) OVER (PARTITION BY symbol) AS last_bar FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
g AS (SELECT symbol, bar_idx, 'bullish' AS type, low AS top, h0 AS bottom, (low + h0) / 2 AS mid, (low - h0) / low * 100 AS gap_pct, last_bar FROM k WHERE h0 < low AND h0 < h1 AND l0 < low AND (low - h0) / nullif(low, 0) * 100 > 0.5
  UNION ALL SELECT symbol, bar_idx, 'bearish', l0, high, (l0 + high) / 2, (l0 - high) / l0 * 100, last_bar FROM k WHERE l0 > high AND l0 > l1 AND h0 > high AND (l0 - high) / nullif(l0, 0) * 100 > 0.5)"""


@query(f"WITH {GAPS} SELECT symbol, bar_idx, type, round(top, 6) AS top, round(bottom, 6) AS bottom, round(mid, 6) AS mid, round(gap_pct, 6) AS gap_pct FROM g")
def fvg(spark, d):
    return r6(patterns.detect_fvg(T.candles(spark, d)))


@query(f"""WITH {GAPS}, r AS (SELECT g.symbol, g.bar_idx, g.type, min(c.bar_idx) AS r FROM g JOIN c ON c.symbol = g.symbol AND c.bar_idx > g.bar_idx AND c.bar_idx <= g.bar_idx + 100 AND c.low <= g.mid AND g.mid <= c.high GROUP BY 1, 2, 3),
e AS (SELECT g.*, coalesce(r, least(g.bar_idx + 100, last_bar)) AS end_bar FROM g LEFT JOIN r USING (symbol, bar_idx, type))
SELECT e.symbol, e.bar_idx, e.type, e.end_bar, CAST(epoch(s.datetime) AS BIGINT) AS start_time, CAST(epoch(n.datetime) AS BIGINT) AS end_time FROM e LEFT JOIN c s ON s.symbol = e.symbol AND s.bar_idx = e.bar_idx - 2 LEFT JOIN c n ON n.symbol = e.symbol AND n.bar_idx = e.end_bar""")
def fvg_lifetimes(spark, d):
    c = T.candles(spark, d)
    return patterns.fvg_lifetimes(patterns.detect_fvg(c), c).select("symbol", "bar_idx", "type", "end_bar", "start_time", "end_time")


FVG_SIGNALS = f"""{GAPS},
e50 AS (SELECT symbol, bar_idx, close AS ema FROM c WHERE bar_idx = 0 UNION ALL SELECT c.symbol, c.bar_idx, 2.0::DOUBLE / 51 * c.close + 49.0::DOUBLE / 51 * e.ema FROM e50 e JOIN c ON c.symbol = e.symbol AND c.bar_idx = e.bar_idx + 1),
tr AS (SELECT symbol, bar_idx, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
av AS (SELECT symbol, bar_idx, {rolled('avg', 'tr', 14)} AS atr FROM tr),
bl AS (SELECT symbol, bar_idx, close, min(low) OVER w AS bl, max(high) OVER w AS bh FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)),
g1 AS (SELECT g.*, atr, CASE WHEN type = 'bullish' THEN bl ELSE bh END AS sl FROM g JOIN bl USING (symbol, bar_idx) JOIN av USING (symbol, bar_idx) JOIN e50 USING (symbol, bar_idx)
  WHERE bar_idx >= 3 AND bar_idx < last_bar AND ((type = 'bullish' AND close > ema) OR (type = 'bearish' AND close < ema))),
r AS (SELECT g1.symbol, g1.bar_idx, g1.type, min(c.bar_idx) AS eb FROM g1 JOIN c ON c.symbol = g1.symbol AND c.bar_idx > g1.bar_idx AND c.bar_idx <= g1.bar_idx + 100 AND c.low - mid * 1e-6::DOUBLE <= mid AND mid <= c.high + mid * 1e-6::DOUBLE GROUP BY 1, 2, 3),
g2 AS (SELECT g1.*, eb, CASE WHEN type = 'bullish' THEN mid - sl ELSE sl - mid END AS risk FROM g1 JOIN r USING (symbol, bar_idx, type) JOIN c ce ON ce.symbol = g1.symbol AND ce.bar_idx = eb JOIN e50 ee ON ee.symbol = g1.symbol AND ee.bar_idx = eb
  WHERE (type = 'bullish' AND ce.close > ee.ema) OR (type = 'bearish' AND ce.close < ee.ema)),
fs AS (SELECT symbol, eb AS bar_idx, CASE WHEN type = 'bullish' THEN 1 ELSE -1 END AS signal, mid AS entry_price, sl AS stop_price, CASE WHEN type = 'bullish' THEN mid + 3 * risk ELSE mid - 3 * risk END AS take_price, risk FROM g2
  WHERE risk > 0 AND NOT coalesce(risk < 0.25::DOUBLE * atr, false) QUALIFY row_number() OVER (PARTITION BY symbol, eb ORDER BY g2.bar_idx, CASE WHEN type = 'bullish' THEN 0 ELSE 1 END) = 1)"""


@query(f"WITH RECURSIVE {FVG_SIGNALS} SELECT symbol, bar_idx, CAST(signal AS INTEGER) AS signal, round(entry_price, 6) AS entry_price, round(stop_price, 6) AS stop_price, round(take_price, 6) AS take_price, round(risk, 6) AS risk FROM fs")
def fvg_signals(spark, d):
    return r6(signals.fvg_signals(T.candles(spark, d)).filter("signal <> 0"), *KEY, "signal", "entry_price", "stop_price", "take_price", "risk")


@query(f"""WITH {CANDLES}, w AS (SELECT *, lag(sh) OVER w AS psh, lag(sl) OVER w AS psl FROM (SELECT *, {rolled('max', 'high', 5)} AS sh, {rolled('min', 'low', 5)} AS sl FROM c) WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
u AS (SELECT w.symbol, w.bar_idx AS bos_bar_idx, 'bullish' AS type, max(o.bar_idx) AS j FROM w JOIN c o ON o.symbol = w.symbol AND o.bar_idx BETWEEN w.bar_idx - 5 AND w.bar_idx - 1 AND o.close < o.open WHERE w.close > psh GROUP BY 1, 2
  UNION ALL SELECT w.symbol, w.bar_idx, 'bearish', max(o.bar_idx) FROM w JOIN c o ON o.symbol = w.symbol AND o.bar_idx BETWEEN w.bar_idx - 5 AND w.bar_idx - 1 AND o.close > o.open WHERE w.close < psl GROUP BY 1, 2)
SELECT u.symbol, bos_bar_idx, type, j AS bar_idx, round(greatest(open, close), 6) AS top, round(least(open, close), 6) AS bottom, round((greatest(open, close) + least(open, close)) / 2, 6) AS mid FROM u JOIN c ON c.symbol = u.symbol AND c.bar_idx = j""")
def orderblocks(spark, d):
    return r6(patterns.detect_orderblocks(T.candles(spark, d)))


@query(f"WITH {MA_RSI} SELECT symbol, bar_idx, CAST(signal AS INTEGER) AS signal FROM s")
def ma_rsi_signals(spark, d):
    return signals.ma_rsi_signals(T.candles(spark, d)).select(*KEY, "signal")


@query(f"""WITH RECURSIVE {CANDLES}, e AS (SELECT symbol, bar_idx, close AS a, 1.0::DOUBLE AS ad, close AS b, 1.0::DOUBLE AS bd FROM c WHERE bar_idx = 0
UNION ALL SELECT c.symbol, c.bar_idx, c.close + 0.8::DOUBLE * a, 1 + 0.8::DOUBLE * ad, c.close + 20.0::DOUBLE / 22 * b, 1 + 20.0::DOUBLE / 22 * bd FROM e JOIN c ON c.symbol = e.symbol AND c.bar_idx = e.bar_idx + 1)
SELECT symbol, count(*) FILTER (WHERE bar_idx > 0 AND a / ad > b / bd) AS buys, count(*) FILTER (WHERE bar_idx > 0 AND a / ad < b / bd) AS sells FROM e GROUP BY 1""")
def ema_cross_counts(spark, d):
    s = signals.ema_cross_signals(T.candles(spark, d))
    return metrics.signal_counts(s.withColumn("signal", F.when(F.col("bar_idx") > 0, F.col("signal")).otherwise(0)))


@query(f"""WITH {CANDLES}, q AS (SELECT event_type AS symbol, ts, value * (1 - CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10000) AS bid, value * (1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10000) AS ask FROM events)
SELECT c.symbol, c.bar_idx, round(q.bid, 6) AS bid, round(q.ask, 6) AS ask FROM c ASOF LEFT JOIN q ON c.symbol = q.symbol AND c.datetime >= q.ts""")
def asof_quotes(spark, d):
    return r6(joins.asof_quotes(T.candles(spark, d), T.quotes(spark, d)), *KEY, "bid", "ask")


@query(f"""WITH {CANDLES}, e AS (SELECT symbol, ts, event_id FROM t), p AS (SELECT e.*, b.datetime AS bt FROM e ASOF LEFT JOIN c b ON b.symbol = e.symbol AND e.ts >= b.datetime),
n AS (SELECT p.*, a.datetime AS aft FROM p ASOF LEFT JOIN c a ON a.symbol = p.symbol AND p.ts <= a.datetime)
SELECT symbol, event_id, CASE WHEN aft IS NULL OR ts - bt <= aft - ts THEN coalesce(bt, aft) ELSE aft END AS nearest FROM n""")
def nearest_candle(spark, d):
    t = T.ticks(spark, d).select("symbol", "ts", "event_id")
    return joins.nearest(t, T.candles(spark, d)).select("symbol", "event_id", "nearest")


TRADE_COLS = "symbol, id, direction, entry_bar_index, round(entry_price, 6) AS entry_price, exit_bar_index, round(exit_price, 6) AS exit_price, exit_reason, round(pnl, 6) AS pnl, round(max_favor, 6) AS max_favor, round(max_adverse, 6) AS max_adverse, round(risk, 6) AS risk"


@query(f"WITH {TRADES} SELECT {TRADE_COLS} FROM tr")
def single_position_ledger(spark, d):
    return r6(T.trades(spark, d), "symbol", "id", "direction", "entry_bar_index", "entry_price", "exit_bar_index", "exit_price", "exit_reason", "pnl", "max_favor", "max_adverse", "risk")


@query(f"""WITH RECURSIVE {TRADES}, k AS (SELECT symbol, id, 1000.0::DOUBLE AS cap, pnl, risk FROM tr WHERE id = 0
UNION ALL SELECT t.symbol, t.id, k.cap * (1 + 0.01::DOUBLE * k.pnl / k.risk), t.pnl, t.risk FROM k JOIN tr t ON t.symbol = k.symbol AND t.id = k.id + 1)
SELECT symbol, id, round(cap * 0.01::DOUBLE / risk, 6) AS size, round(cap * 0.01::DOUBLE * pnl / risk, 6) AS pnl FROM k""")
def compounding_ledger(spark, d):
    return r6(T.trades(spark, d, risk_percent=1.0), "symbol", "id", "size", "pnl")


@query(f"""WITH RECURSIVE {MA_RSI}, e AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS id, signal AS dir, bar_idx AS eb, close AS ep, close * (1 - 0.05::DOUBLE * signal) AS sp, close * (1 + 0.10::DOUBLE * signal) AS tp FROM s WHERE signal <> 0),
h AS (SELECT e.symbol, e.id, min(c.bar_idx) AS xb FROM e JOIN c ON c.symbol = e.symbol AND c.bar_idx > e.eb AND ((dir > 0 AND (c.low <= sp OR c.high >= tp)) OR (dir < 0 AND (c.high >= sp OR c.low <= tp))) GROUP BY 1, 2),
z AS (SELECT symbol, max(bar_idx) AS zb, arg_max(close, bar_idx) AS zc FROM c GROUP BY 1),
x AS (SELECT e.*, coalesce(h.xb, zb) AS xb, h.xb AS done, CASE WHEN h.xb IS NULL THEN 'eod' WHEN (dir > 0 AND c.low <= sp) OR (dir < 0 AND c.high >= sp) THEN 'sl' ELSE 'tp' END AS reason, zc FROM e JOIN z USING (symbol) LEFT JOIN h USING (symbol, id) LEFT JOIN c ON c.symbol = e.symbol AND c.bar_idx = h.xb),
u AS (SELECT *, CASE reason WHEN 'sl' THEN sp WHEN 'tp' THEN tp ELSE zc END AS px, 0.01::DOUBLE * (CASE reason WHEN 'sl' THEN sp WHEN 'tp' THEN tp ELSE zc END - ep) * dir / abs(ep - sp) AS g FROM x),
k AS (SELECT symbol, id, 1000.0::DOUBLE AS cap, [{{'b': done, 'p': 1000 * g}}] AS l FROM u WHERE id = 0
UNION ALL SELECT symbol, id, cap, list_append(l, {{'b': done, 'p': cap * g}}) FROM (
  SELECT u.symbol, u.id, u.done, u.g, k.l, 1000 + coalesce(list_sum(list_transform(list_filter(k.l, lambda q: q.b <= u.eb), lambda q: q.p)), 0) AS cap FROM k JOIN u ON u.symbol = k.symbol AND u.id = k.id + 1) v)
SELECT u.symbol, CAST(u.id AS BIGINT) AS id, CASE WHEN dir > 0 THEN 'long' ELSE 'short' END AS direction, eb AS entry_bar_index, round(ep, 6) AS entry_price, round(cap * 0.01::DOUBLE / abs(ep - sp), 6) AS size, xb AS exit_bar_index, round(px, 6) AS exit_price, reason AS exit_reason, round(cap * g, 6) + 0.0::DOUBLE AS pnl FROM u JOIN k USING (symbol, id)""")
def hedge_ledger(spark, d):
    return r6(ledger.hedge_ledger(T.ma_rsi(spark, d), risk_percent=1.0))


@query()
def live_rule_ledger(spark, d):
    return formatting.alert_text(ledger.live_rule_ledger(T.ma_rsi(spark, d)))


@query(f"""WITH {EQUITY} SELECT symbol, 1000.0::DOUBLE AS initial_capital, round(1000 + sum(pnl), 2) AS final_balance, round(sum(pnl), 2) AS net_profit, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl <= 0) AS losses,
round(100.0::DOUBLE * count(*) FILTER (WHERE pnl > 0) / count(*), 2) AS win_rate_pct, round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0), 2) AS gross_profit, round(coalesce(sum(pnl) FILTER (WHERE pnl <= 0), 0), 2) AS gross_loss,
CASE WHEN sum(pnl) FILTER (WHERE pnl <= 0) < 0 THEN round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / abs(sum(pnl) FILTER (WHERE pnl <= 0)), 2) ELSE 'Infinity'::DOUBLE END AS profit_factor, round(100 * min(drawdown), 2) AS max_drawdown_pct FROM q GROUP BY 1""")
def performance_summary(spark, d):
    return metrics.performance_summary(T.trades(spark, d))


@query(f"""WITH {EQUITY}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_time, id) AS n, count(*) OVER (PARTITION BY symbol) AS nt FROM q),
w AS (SELECT symbol, n AS wn, peak AS wp FROM o QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY drawdown, n) = 1),
lz AS (SELECT o.symbol, o.n, o.equity, wn, wp FROM o JOIN w USING (symbol) WHERE n >= wn AND wn < nt QUALIFY row_number() OVER (PARTITION BY o.symbol ORDER BY equity DESC, n) = 1),
sz AS (SELECT symbol, count(*) AS trades, sum(pnl) AS net, sum(pnl) FILTER (WHERE pnl > 0) AS gp, sum(pnl) FILTER (WHERE pnl < 0) AS gl, avg(pnl) FILTER (WHERE pnl > 0) AS ag, avg(pnl) FILTER (WHERE pnl < 0) AS al, avg(pnl) AS ex, min(dd_value) AS dv, 100 * min(drawdown) AS dp,
  avg(date_diff('second', entry_time, exit_time)) AS du, datesub('day', min(entry_time), max(exit_time)) AS days, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(count(*)) AS sh FROM q GROUP BY 1)
SELECT sz.symbol, trades, round(net, 6) AS net_profit, round(CASE WHEN gl < 0 THEN coalesce(gp, 0) / abs(gl) END, 6) AS profit_factor, round(ag, 6) AS avg_gain, round(al, 6) AS avg_loss, round(ex, 6) AS expectancy, round(dv, 6) AS max_dd_value, round(dp, 6) AS max_dd_pct,
CASE WHEN lz.equity >= lz.wp THEN lz.n - lz.wn END AS recovery_trades, round(du, 6) AS avg_duration_s, round(CASE WHEN days > 0 THEN (power((1000 + net) / 1000, 365.0::DOUBLE / days) - 1) * 100 END, 6) AS annual_return_pct, round(sh, 6) AS sharpe FROM sz LEFT JOIN lz USING (symbol)""")
def extended_metrics(spark, d):
    return r6(metrics.extended_metrics(T.trades(spark, d)))


@query(f"WITH {EQUITY} SELECT symbol, id, round(equity, 6) AS equity, round(peak, 6) AS peak, round(drawdown, 6) AS drawdown FROM q")
def equity_curve(spark, d):
    return r6(metrics.equity_curve(T.trades(spark, d), 1000.0), "symbol", "id", "equity", "peak", "drawdown")


@query(f"""WITH {EQUITY}, m AS (SELECT symbol, CAST(date_trunc('month', exit_time) AS DATE) AS month, 100 * min(drawdown) AS dd FROM q GROUP BY 1, 2),
cal AS (SELECT symbol, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 month)) AS DATE) AS month FROM m GROUP BY 1)
SELECT cal.symbol, CAST(cal.month AS VARCHAR) AS month, round(coalesce(dd, 0.0), 6) AS dd_pct FROM cal LEFT JOIN m USING (symbol, month)""")
def monthly_drawdown(spark, d):
    return r6(metrics.monthly_drawdown(T.trades(spark, d)).withColumn("month", F.col("month").cast("string")))


@query(f"WITH {EQUITY} SELECT symbol, CAST(year(exit_time) AS BIGINT) AS year, round(arg_max(equity, (exit_time, id)), 6) AS equity_end, round(min(equity), 6) AS equity_low, round(max(equity), 6) AS equity_high FROM q GROUP BY 1, 2")
def equity_by_year(spark, d):
    return r6(metrics.equity_by_year(T.trades(spark, d)))


@query(f"WITH {EQUITY}, z AS (SELECT *, max(exit_time) OVER (PARTITION BY symbol) AS z FROM q) SELECT symbol, id, round(equity, 6) AS equity FROM z WHERE exit_time >= CAST(CAST(z AS DATE) - INTERVAL 3 month AS DATE)")
def equity_last_months(spark, d):
    return r6(metrics.equity_last_months(T.trades(spark, d)), "symbol", "id", "equity")


def _clock_sql(unit: str, top: int, expr: str) -> str:
    return f"WITH {TRADES}, k AS (SELECT symbol, CAST({expr} AS BIGINT) AS {unit}, sum(pnl) AS pnl FROM tr GROUP BY 1, 2), u AS (SELECT DISTINCT symbol FROM tr) SELECT u.symbol, h.v AS {unit}, round(coalesce(k.pnl, 0.0), 6) AS pnl FROM u CROSS JOIN (SELECT unnest(generate_series(0, {top})) AS v) h LEFT JOIN k ON k.symbol = u.symbol AND k.{unit} = h.v"


@query(_clock_sql("hour", 23, "hour(entry_time)"))
def pnl_by_hour(spark, d):
    return r6(metrics.pnl_by_clock(T.trades(spark, d), "hour"))


@query(_clock_sql("weekday", 6, "isodow(entry_time) - 1"))
def pnl_by_weekday(spark, d):
    return r6(metrics.pnl_by_clock(T.trades(spark, d), "weekday"))


@query(f"WITH {TRADES} SELECT symbol, CAST(isodow(exit_time) - 1 AS BIGINT) AS weekday, " + ", ".join(f"round(avg(pnl) FILTER (WHERE hour(exit_time) = {h}), 6) AS h{h}" for h in range(24)) + " FROM tr GROUP BY 1, 2")
def weekday_hour_heatmap(spark, d):
    return r6(metrics.heatmap(T.trades(spark, d)))


@query(f"WITH {TRADES} SELECT symbol, CAST(CAST(date_trunc('month', exit_time) AS DATE) AS VARCHAR) AS period, round(sum(pnl), 6) AS pnl, round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / abs(sum(pnl) FILTER (WHERE pnl < 0)), 6) AS profit_factor FROM tr GROUP BY 1, 2")
def pnl_by_month(spark, d):
    return r6(metrics.pnl_by_period(T.trades(spark, d)).withColumn("period", F.col("period").cast("string")))


@query(f"""WITH {TRADES}, v AS (SELECT symbol, round(pnl, 6) AS v FROM tr), m AS (SELECT symbol, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1)
SELECT symbol, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 40)), 39) ELSE 20 END AS BIGINT) AS bin, count(*) AS n FROM v JOIN m USING (symbol) GROUP BY 1, 2""")
def pnl_histogram(spark, d):
    return metrics.histogram(T.trades(spark, d), F.round("pnl", 6))


@query(f"""WITH {TRADES}, v AS (SELECT symbol, 'risk_reward' AS measure, round(pnl / nullif(risk, 0), 6) AS v FROM tr UNION ALL SELECT symbol, 'duration_h', round(date_diff('second', entry_time, exit_time) / 3600, 6) FROM tr
  UNION ALL SELECT symbol, 'r_multiple', round(pnl / nullif(abs(max_adverse), 0), 6) FROM tr), m AS (SELECT symbol, measure, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1, 2)
SELECT symbol, measure, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 40)), 39) ELSE 20 END AS BIGINT) AS bin, count(*) AS n FROM v JOIN m USING (symbol, measure) WHERE v IS NOT NULL GROUP BY 1, 2, 3""")
def trade_histograms(spark, d):
    """Risk-reward ratios, hours held and R multiples, each in 40 bins a symbol."""
    t = metrics.r_multiples(T.trades(spark, d))
    measures = {"risk_reward": F.col("risk_reward"), "duration_h": F.col("duration_s") / 3600, "r_multiple": F.col("r")}
    rows = t.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.round(v, 6).alias("v")) for n, v in measures.items()])).alias("m")).select("symbol", "m.*")
    return metrics.histogram(rows, F.col("v"), keys=("symbol", "measure"))


@query(f"WITH {TR} SELECT symbol, bar_idx, close, volume, round({rolled('avg', 'tr', 14)}, 6) AS atr FROM tr QUALIFY atr IS NOT NULL")
def price_volume_atr(spark, d):
    """The points of close, volume and ATR, where there is an ATR."""
    return r6(I.add_atr(T.candles(spark, d)), *KEY, "atr", "close", "volume").filter("atr is not null")


@query(f"""WITH {TRADES}, k AS (SELECT symbol, CAST(isodow(exit_time) - 1 AS BIGINT) AS weekday, pnl FROM tr), q AS (SELECT symbol, weekday, count(*) AS n, quantile_cont(pnl, 0.25) AS q1, quantile_cont(pnl, 0.5) AS m, quantile_cont(pnl, 0.75) AS q3 FROM k GROUP BY 1, 2),
r AS (SELECT k.*, pnl BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM k JOIN q USING (symbol, weekday)), w AS (SELECT symbol, weekday, min(pnl) FILTER (WHERE inside) AS wl, max(pnl) FILTER (WHERE inside) AS wh, count(*) FILTER (WHERE NOT inside) AS o FROM r GROUP BY 1, 2)
SELECT symbol, weekday, n, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, round(wl, 6) AS whisker_low, round(wh, 6) AS whisker_high, o AS outliers FROM q JOIN w USING (symbol, weekday)""")
def box_by_weekday(spark, d):
    return r6(metrics.box_stats(T.trades(spark, d)))


@query(f"""WITH {TRADES}, r AS (SELECT *, pnl / nullif(abs(max_adverse), 0) AS r FROM tr), sz AS (SELECT symbol, count(*) AS trades, avg(r) AS mr, count(*) FILTER (WHERE pnl > 0) / count(*) AS wr, coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0) / abs(avg(pnl) FILTER (WHERE pnl < 0)) AS po FROM r GROUP BY 1)
SELECT symbol, trades, round(mr, 6) AS mean_r, round(wr, 6) AS win_rate, round(po, 6) AS payoff, round(CASE WHEN po > 0 THEN wr - (1 - wr) / po END, 6) AS kelly FROM sz""")
def r_and_kelly(spark, d):
    return r6(metrics.r_and_kelly(T.trades(spark, d)))


@query(f"WITH {TRADES} SELECT symbol, round(sum(0.001::DOUBLE * (entry_price + exit_price)), 6) AS commission, round(1000 + sum(pnl - 0.001::DOUBLE * (entry_price + exit_price)), 6) AS balance FROM tr GROUP BY 1")
def commission_totals(spark, d):
    return r6(metrics.totals(T.trades(spark, d, commission=0.001)))


@query(f"""WITH {TRADES}, k AS (SELECT symbol, id, pnl, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, id) AS best, row_number() OVER (PARTITION BY symbol ORDER BY pnl, id) AS worst FROM (SELECT symbol, id, round(pnl, 6) AS pnl FROM tr))
SELECT symbol, id, pnl, best, worst FROM k WHERE best <= 20 OR worst <= 20""")
def best_and_worst_trades(spark, d):
    return metrics.best_and_worst(r6(T.trades(spark, d), "symbol", "id", "pnl"))


@query(f"WITH {CANDLES} SELECT symbol, bar_idx, close FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) <= 1000")
def last_bars(spark, d):
    return metrics.last_n(T.candles(spark, d), 1000).select(*KEY, "close")


@query(f"""WITH {TRADES}, p AS (SELECT symbol, id, greatest((200 - (exit_bar_index - entry_bar_index)) // 2, 30) AS pad, entry_bar_index AS a, exit_bar_index AS b FROM tr)
SELECT p.symbol, p.id, count(*) AS bars, min(c.bar_idx) AS first_bar, max(c.bar_idx) AS last_bar FROM p JOIN c ON c.symbol = p.symbol AND c.bar_idx BETWEEN a - pad AND b + pad GROUP BY 1, 2""")
def bars_around_trades(spark, d):
    around = joins.bars_around(T.trades(spark, d), T.candles(spark, d))
    return around.groupBy("symbol", "id").agg(F.count("*").alias("bars"), F.min("bar_idx").alias("first_bar"), F.max("bar_idx").alias("last_bar"))


def _positions(spark, d):
    """Every trade as if it were still open."""
    t = T.trades(spark, d)
    return t.select("symbol", "id", F.col("direction").alias("side"), F.lit(2.0).alias("quantity"), "entry_price", F.col("stop_price").alias("stop_loss"), F.col("take_price").alias("take_profit"), F.lit(1000.0).alias("balance"))


POSITIONS = f"""{TRADES}, p AS (SELECT symbol, id, direction, entry_price, CASE direction WHEN 'long' THEN 1 ELSE -1 END AS dir FROM tr), lp AS (SELECT symbol, arg_max(close, datetime) AS px FROM c GROUP BY 1)"""


@query(f"WITH {POSITIONS} SELECT symbol, id, round((px - entry_price) * 2 * dir, 6) AS open_pnl, round(1000 + (px - entry_price) * 2 * dir, 6) AS equity FROM p LEFT JOIN lp USING (symbol)")
def mark_to_market(spark, d):
    return r6(joins.mark_to_market(_positions(spark, d), T.candles(spark, d)), "symbol", "id", "open_pnl", "equity")


@query(f"""WITH {POSITIONS}, z AS (SELECT symbol, id, dir, px, entry_price * (1 - 0.05::DOUBLE * dir) AS sl, entry_price * (1 + 0.10::DOUBLE * dir) AS tp FROM p JOIN lp USING (symbol))
SELECT symbol, id, CASE WHEN px * dir <= sl * dir THEN 'Recovered SL' ELSE 'Recovered TP' END AS reason, round(CASE WHEN px * dir <= sl * dir THEN sl ELSE tp END, 6) AS exit_price FROM z WHERE px * dir <= sl * dir OR px * dir >= tp * dir""")
def reconcile_positions(spark, d):
    return r6(joins.reconcile(_positions(spark, d), T.candles(spark, d)), "symbol", "id", "reason", "exit_price")


@query(f"""WITH {TRADES}, sn AS (SELECT symbol, id, pnl, pnl > 0 AS seen FROM tr), nu AS (SELECT *, count(*) FILTER (WHERE NOT seen) OVER (PARTITION BY symbol) AS fresh FROM sn)
SELECT symbol, id, round(pnl, 6) AS pnl FROM nu WHERE NOT seen OR fresh = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY {_mix_sql('7', 'id')}, id) = 1""")
def next_unseen_trade(spark, d):
    """The trades that won have been seen."""
    t = T.trades(spark, d).select("symbol", "id", "pnl")
    return r6(joins.next_unseen(t, t.filter("pnl > 0")))


@query(f"""WITH {TRADES}, za AS (SELECT symbol, high - low AS range, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) AS position FROM c), zb AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY id) AS position FROM tr)
SELECT symbol, position, round(range, 6) AS range, round(pnl, 6) AS pnl FROM za JOIN zb USING (symbol, position)""")
def range_and_pnl_zip(spark, d):
    c = T.candles(spark, d).select("symbol", "bar_idx", (F.col("high") - F.col("low")).alias("range"))
    z = joins.zip_by_position(c, T.trades(spark, d).select("symbol", "id", "pnl"), "bar_idx", "id")
    return r6(z.withColumn("position", F.col("position").cast("long")), "symbol", "position", "range", "pnl")


BOOK = f"""{TICKS}, lv AS (SELECT symbol, ts AS snapshot_ts, side, price * (1 + CASE side WHEN 'bid' THEN -1 ELSE 1 END * k / 1000.0::DOUBLE) AS price, qty * (4 - k) + 1 AS qty, k AS level FROM t CROSS JOIN (VALUES ('bid'), ('ask')) s(side) CROSS JOIN (VALUES (1), (2), (3)) l(k))"""


@query(f"""WITH {BOOK} SELECT symbol, snapshot_ts, side, CAST(level AS BIGINT) AS level, round(sum(qty) OVER (PARTITION BY symbol, snapshot_ts, side ORDER BY level), 6) AS cum_qty, round(sum(qty) OVER (PARTITION BY symbol, snapshot_ts, side ORDER BY level) / sum(qty) OVER (PARTITION BY symbol, snapshot_ts, side), 6) AS share,
round(price * qty, 6) AS notional, round(qty / max(qty) OVER (PARTITION BY symbol, snapshot_ts), 6) AS relative FROM lv""")
def book_depth(spark, d):
    return r6(orderbook.depth(orderbook.levels(T.books(spark, d))), "symbol", "snapshot_ts", "side", "level", "cum_qty", "share", "notional", "relative")


@query(f"WITH {BOOK} SELECT symbol, snapshot_ts, round(max(price) FILTER (WHERE side = 'bid'), 6) AS best_bid, round(min(price) FILTER (WHERE side = 'ask'), 6) AS best_ask, round((max(price) FILTER (WHERE side = 'bid') + min(price) FILTER (WHERE side = 'ask')) / 2, 6) AS mid FROM lv WHERE level <= 2 GROUP BY 1, 2")
def book_best_prices(spark, d):
    return r6(orderbook.best_prices(orderbook.levels(orderbook.top_levels(T.books(spark, d), 2))))


@query(f"""WITH {TICKS}, lv AS (SELECT symbol, ts AS snapshot_ts, 'bid' AS side, floor(price) AS price, qty, dense_rank() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM t),
j AS (SELECT a.*, coalesce(b.qty, 0) AS old_qty FROM lv a LEFT JOIN lv b ON b.symbol = a.symbol AND b.price = a.price AND b.n = a.n - 1)
SELECT symbol, snapshot_ts, price, qty, CASE WHEN qty > old_qty THEN 'up' WHEN qty < old_qty THEN 'down' ELSE 'same' END AS change FROM j""")
def book_changes(spark, d):
    t = T.ticks(spark, d).select("symbol", F.col("ts").alias("snapshot_ts"), F.lit("bid").alias("side"), F.floor("price").cast("double").alias("price"), "qty")
    return orderbook.changes(t).select("symbol", "snapshot_ts", "price", "qty", "change")


GRID = ([5, 9], [21, 34], [55.0, 60.0], [40.0, 45.0])


def _grid_sql(bars: str, keys: str) -> str:
    """ff: every combination's result by ``keys`` over the table ``bars``."""
    mean = lambda col, n: rolled("avg", col, n).replace("PARTITION BY symbol", f"PARTITION BY {keys}")
    return f"""gd AS (SELECT *, close - lag(close) OVER (PARTITION BY {keys} ORDER BY bar_idx) AS delta FROM {bars}),
gu AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0.0::DOUBLE END AS up, CASE WHEN delta < 0 THEN -delta ELSE 0.0::DOUBLE END AS down FROM gd),
gr AS (SELECT *, {mean("up", 14)} AS au, {mean("down", 14)} AS ad, {mean("close", 5)} AS m5, {mean("close", 9)} AS m9, {mean("close", 21)} AS m21, {mean("close", 34)} AS m34, count(*) OVER (PARTITION BY {keys}) AS nb FROM gu),
rs AS (SELECT *, coalesce(100 - 100 / (1 + au / nullif(ad, 0)), 50.0::DOUBLE) AS rsi FROM gr),
pg AS (SELECT (row_number() OVER (ORDER BY s, l, b, e)) - 1 AS combo_id, * FROM (VALUES (5), (9)) s(s) CROSS JOIN (VALUES (21), (34)) l(l) CROSS JOIN (VALUES (55.0::DOUBLE), (60.0::DOUBLE)) b(b) CROSS JOIN (VALUES (40.0::DOUBLE), (45.0::DOUBLE)) e(e)),
sg AS (SELECT {keys}, bar_idx, close, combo_id, s, l, b, e, CASE s WHEN 5 THEN m5 ELSE m9 END AS ms, CASE l WHEN 21 THEN m21 ELSE m34 END AS ml, rsi FROM rs CROSS JOIN pg WHERE nb >= 200),
si AS (SELECT *, CASE WHEN ms > ml AND rsi > b THEN 1 WHEN ms < ml AND rsi < e THEN -1 ELSE 0 END AS signal FROM sg),
pa AS (SELECT {keys}, combo_id, signal, close, row_number() OVER w AS k, lead(close) OVER w AS nx FROM si WHERE signal <> 0 WINDOW w AS (PARTITION BY {keys}, combo_id ORDER BY bar_idx)),
pp AS (SELECT {keys}, combo_id, CASE WHEN signal > 0 THEN nx - close ELSE close - nx END AS pnl FROM pa WHERE k % 2 = 1 AND nx IS NOT NULL),
gg AS (SELECT {keys}, combo_id, sum(pnl) AS pnl, count(*) FILTER (WHERE pnl > 0) / count(*) AS wr FROM pp GROUP BY ALL),
ff AS (SELECT u.*, pg.combo_id, s, l, b, e, round(1000 + coalesce(pnl, 0), 6) AS equity_final, round(coalesce(wr, 0.0), 6) AS win_rate FROM (SELECT DISTINCT {keys} FROM rs WHERE nb >= 200) u CROSS JOIN pg LEFT JOIN gg USING ({keys}, combo_id))"""


COMBO = "combo_id, CAST(s AS INTEGER) AS short, CAST(l AS INTEGER) AS long, b AS buy, e AS sell, equity_final, win_rate"


@query(f"WITH {CANDLES}, {_grid_sql('c', 'symbol')} SELECT symbol, {COMBO}, row_number() OVER (PARTITION BY symbol ORDER BY equity_final DESC, combo_id) AS rank FROM ff")
def grid_search(spark, d):
    return r6(sweeps.optimize(T.candles(spark, d), sweeps.grid(spark, *GRID)), "symbol", "combo_id", "short", "long", "buy", "sell", "equity_final", "win_rate", "rank")


@query(f"""WITH {CANDLES}, fs AS (SELECT *, datesub('second', min(datetime) OVER (PARTITION BY symbol), datetime) AS age, datesub('second', min(datetime) OVER (PARTITION BY symbol), max(datetime) OVER (PARTITION BY symbol)) AS span FROM c),
fc AS (SELECT fs.*, fold FROM fs, (SELECT unnest(generate_series(0, 999)) AS fold) WHERE fold * 259200 + 604800 <= span AND age BETWEEN fold * 259200 AND fold * 259200 + 604800),
{_grid_sql('fc', 'symbol, fold')} SELECT symbol, fold, {COMBO} FROM ff QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY equity_final DESC, combo_id) = 1""")
def walk_forward(spark, d):
    """Weekly windows every third day: the given series cover a month."""
    return r6(sweeps.walk_forward(T.candles(spark, d), sweeps.grid(spark, *GRID), window_days=7, every_days=3))


def _ema_grid_sql() -> str:
    periods = range(5, 35)
    seed = ", ".join(f"close AS n{p}" for p in periods)
    step = ", ".join(f"c.close + (1 - 2.0::DOUBLE / {p + 1}) * n{p}" for p in periods)
    pairs = ", ".join(f"({p}, n{p})" for p in periods)
    cells = ", ".join(f"round(sum(pnl) FILTER (WHERE slow = {s}), 6) + 0.0::DOUBLE AS s{s}" for s in range(15, 35))
    return f"""WITH RECURSIVE {CANDLES}, e AS (SELECT symbol, bar_idx, close, {seed} FROM c WHERE bar_idx = 0 UNION ALL SELECT c.symbol, c.bar_idx, c.close, {step} FROM e JOIN c ON c.symbol = e.symbol AND c.bar_idx = e.bar_idx + 1),
v AS (SELECT symbol, bar_idx, close, p, CASE WHEN bar_idx = 0 THEN close ELSE n * (2.0::DOUBLE / (p + 1)) / (1 - power(1 - 2.0::DOUBLE / (p + 1), bar_idx + 1)) END AS v FROM e, LATERAL (VALUES {pairs}) l(p, n)),
g AS (SELECT a.symbol, a.bar_idx, a.close, a.p AS fast, b.p AS slow, sign(a.v - b.v) AS sg FROM v a JOIN v b ON a.symbol = b.symbol AND a.bar_idx = b.bar_idx AND a.p < 15 AND b.p >= 15),
z AS (SELECT symbol, arg_max(close, bar_idx) AS z FROM c GROUP BY 1),
k AS (SELECT symbol, fast, slow, (coalesce(lead(close) OVER (PARTITION BY symbol, fast, slow ORDER BY bar_idx), z) - close) * sg AS pnl FROM g JOIN z USING (symbol) WHERE sg <> 0)
SELECT symbol, CAST(fast AS INTEGER) AS fast, {cells} FROM k GROUP BY 1, 2"""


@query(_ema_grid_sql())
def ema_robustness_grid(spark, d):
    return r6(sweeps.ema_grid(T.candles(spark, d)))


def _mc_sql(sims: int) -> str:
    return f"""{TRADES}, k AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM tr), r AS (SELECT k.*, sim, {_mix_sql('7', 'sim', 'k')} AS draw FROM k CROSS JOIN (SELECT unnest(generate_series(0, {sims - 1})) AS sim))"""


BOOTSTRAP = "mb AS (SELECT r.symbol, r.sim, k.pnl, r.k AS o1, 0 AS o2 FROM r JOIN k ON k.symbol = r.symbol AND k.k = r.draw % r.n)"
MC_END = "me AS (SELECT symbol, sim, 1000 + sum(pnl) OVER (PARTITION BY symbol, sim ORDER BY o1, o2 ROWS UNBOUNDED PRECEDING) AS eq, o1, o2 FROM mb), f AS (SELECT symbol, sim, eq, eq - max(eq) OVER (PARTITION BY symbol, sim ORDER BY o1, o2 ROWS UNBOUNDED PRECEDING) AS dd, row_number() OVER (PARTITION BY symbol, sim ORDER BY o1 DESC, o2 DESC) AS last FROM me), y AS (SELECT symbol, sim, round(max(eq) FILTER (WHERE last = 1), 6) AS final_equity, round(min(dd), 6) AS max_dd FROM f GROUP BY 1, 2)"
SHUFFLES, BOOTSTRAPS = 10_000, 500


def _exact_mean(column: str) -> str:
    """The mean of values of 6 digits to 4 digits, half away from zero, in whole numbers alone."""
    total = f"sum(CAST(round({column} * 1000000) AS HUGEINT))"
    return f"CAST(sign({total}) * ((2 * abs({total}) + 100 * count(*)) // (200 * count(*))) AS DOUBLE) / 10000"


@query(f"WITH {_mc_sql(SHUFFLES)}, mb AS (SELECT symbol, sim, pnl, draw AS o1, k AS o2 FROM r), {MC_END} SELECT * FROM y")
def monte_carlo_shuffle(spark, d):
    return r6(sweeps.monte_carlo(T.trades(spark, d), SHUFFLES, "shuffle"))


@query(f"WITH {_mc_sql(BOOTSTRAPS)}, {BOOTSTRAP}, {MC_END} SELECT * FROM y")
def monte_carlo_bootstrap(spark, d):
    return r6(sweeps.monte_carlo(T.trades(spark, d), BOOTSTRAPS, "bootstrap"))


@query(f"""WITH {_mc_sql(BOOTSTRAPS)}, {BOOTSTRAP}, {MC_END}
SELECT symbol, {_exact_mean("final_equity")} AS mean_final, round(quantile_cont(final_equity, 0.5), 6) AS median_final, min(final_equity) AS worst_final, {_exact_mean("max_dd")} AS mean_dd, round(quantile_cont(max_dd, 0.5), 6) AS median_dd, min(max_dd) AS worst_dd FROM y GROUP BY 1""")
def monte_carlo_summary(spark, d):
    s = sweeps.monte_carlo_summary(r6(sweeps.monte_carlo(T.trades(spark, d), BOOTSTRAPS, "bootstrap")))
    return r6(s.withColumns({c: F.round(c, 4).cast("double") for c in ("mean_final", "mean_dd")}))


@query(f"""WITH {_mc_sql(BOOTSTRAPS)}, {BOOTSTRAP}, {MC_END}, m AS (SELECT symbol, min(final_equity) AS lo, max(final_equity) AS hi FROM y GROUP BY 1)
SELECT symbol, CAST(CASE WHEN hi > lo THEN least(floor((final_equity - lo) / ((hi - lo) / 40)), 39) ELSE 20 END AS BIGINT) AS bin, count(*) AS n FROM y JOIN m USING (symbol) GROUP BY 1, 2""")
def monte_carlo_histogram(spark, d):
    return metrics.histogram(r6(sweeps.monte_carlo(T.trades(spark, d), BOOTSTRAPS, "bootstrap")), F.col("final_equity"))


@query(f"""WITH {TRADES}, nz AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_time, id) AS k FROM tr)
SELECT symbol, id, '#' || k AS label, strftime(entry_time, '%Y-%m-%d') AS day, hour(entry_time) AS hour, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(entry_time)] AS weekday, CASE direction WHEN 'long' THEN 'buy' ELSE 'sell' END AS direction_class,
CASE WHEN pnl > 0 THEN 'positive' WHEN pnl < 0 THEN 'negative' ELSE 'neutral' END AS pnl_class, 'closed' AS status FROM nz""")
def trade_register(spark, d):
    return formatting.trade_register(T.trades(spark, d)).select("symbol", "id", "label", "day", "hour", "weekday", "direction_class", "pnl_class", "status")


@query(f"WITH {TRADES} SELECT symbol, id, round(max_favor, 6) AS max_favor, round(max_adverse, 6) AS max_adverse, round(date_diff('second', entry_time, exit_time) / 60, 6) AS duration_min, round(pnl, 6) AS pnl FROM tr")
def scatter_features(spark, d):
    return r6(T.trades(spark, d).withColumn("duration_min", F.col("duration_s") / 60), "symbol", "id", "max_favor", "max_adverse", "duration_min", "pnl")


LIVE = """l AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'short' END AS side, value AS ep, value * 1.01::DOUBLE AS cp, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 4)::DOUBLE END AS q, CASE WHEN event_id % 3 = 0 THEN event_id / 10.0::DOUBLE END AS px FROM events)"""


@query(f"WITH {LIVE} SELECT id, round(coalesce(px, (cp - ep) * coalesce(q, 1) * CASE side WHEN 'buy' THEN 1 ELSE -1 END), 6) + 0.0::DOUBLE AS pnl FROM l")
def realized_pnl(spark, d):
    e, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    text = lambda c: c.cast("string")
    rows = e.select(
        k.alias("id"), F.when(k % 2 == 0, "buy").otherwise("short").alias("side"), text(F.col("value")).alias("entry_exec"), F.lit("").alias("entry_raw"), F.lit("x").alias("close_exec"), text(F.col("value") * 1.01).alias("close_raw"),
        F.when(k % 5 == 0, "").otherwise(text(k % 4)).alias("quantity"), F.when(k % 3 == 0, text(k / 10.0)).otherwise("").alias("pnl_exec"),
    )
    return r6(ledger.realized_pnl(rows), "id", "pnl")


@query(f"WITH {LIVE} SELECT id, round(ep * coalesce(q, 0), 6) AS notional_entry_exec, round(cp * coalesce(q, 0), 6) AS notional_close_exec, round((ep * coalesce(q, 0) + cp * coalesce(q, 0)) * 0.0004::DOUBLE, 6) AS commission_usdt, round((cp - ep) * coalesce(q, 0) * CASE side WHEN 'buy' THEN 1 ELSE -1 END, 6) + 0.0::DOUBLE AS pnl_mid FROM l")
def ledger_costs(spark, d):
    e, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    rows = e.select(
        k.alias("id"), F.when(k % 2 == 0, "buy").otherwise("short").alias("side"), F.col("value").alias("entry_exec"), F.col("value").alias("entry_raw"), (F.col("value") * 1.01).alias("close_exec"), (F.col("value") * 1.01).alias("close_raw"), F.when(k % 5 == 0, 0.0).otherwise((k % 4).cast("double")).alias("quantity")
    )
    return r6(ledger.ledger_costs(rows, 0.0004), "id", "notional_entry_exec", "notional_close_exec", "commission_usdt", "pnl_mid")


@query("""SELECT event_id, round(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 1.001::DOUBLE END, value) * 1.0002::DOUBLE * 1.0004::DOUBLE, 6) AS buy_price, round(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 0.999::DOUBLE END, value) * 0.9998::DOUBLE * 0.9996::DOUBLE, 6) AS sell_price, round(1000 * 0.01::DOUBLE / nullif(value, 0), 6) AS size FROM events""")
def execution_prices(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    known = F.col("event_id") % 3 != 0
    bid, ask, mid = F.when(known, F.col("value") * 0.999), F.when(known, F.col("value") * 1.001), F.col("value")
    return r6(e.select("event_id", ledger.exec_buy(bid, ask, mid, 0.0004, 0.0002).alias("buy_price"), ledger.exec_sell(bid, ask, mid, 0.0004, 0.0002).alias("sell_price"), ledger.position_size(F.lit(1000.0), 1.0, mid).alias("size")))


@query(f"""WITH {TRADES} SELECT symbol, id, translate(format('{{:,.2f}}', entry_price), ',.', '.,') AS money, format('{{:,.2f}}', entry_price) AS plain,
CASE WHEN pnl >= 0 THEN '+' ELSE '-' END || CAST(CAST(round(abs(CAST(CAST(pnl AS VARCHAR) AS DECIMAL(38, 18))), 2) AS DECIMAL(18, 2)) AS VARCHAR) || '%' AS percent, strftime(entry_time, '%Y-%m-%d') AS day FROM tr""")
def money_texts(spark, d):
    t = T.trades(spark, d)
    return t.select("symbol", "id", formatting.money(F.col("entry_price")).alias("money"), formatting.money_plain(F.col("entry_price")).alias("plain"), formatting.signed_percent(F.col("pnl")).alias("percent"), formatting.date_part(F.col("entry_time").cast("string")).alias("day"))
