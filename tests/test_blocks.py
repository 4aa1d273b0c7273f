"""Series cut into blocks: the same results at any block size, and plans without a window over a whole symbol."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import blocks
from barline.operators import indicators, patterns, signals
from barline.plans import tables

SF = "/root/testdata/sf0.001"

ADDED = {
    "sma": lambda d: indicators.add_sma(d, 20),
    "swings": indicators.add_swings,
    "emas": lambda d: indicators.add_emas(d, {"a": 1, "b": 2, "c": 9, "d": 50}),
    "weighted": lambda d: indicators.add_emas_weighted(d, {"a": 2, "b": 34}),
    "seeded": lambda d: indicators.add_ema_sma_seeded(d, 20),
    "rsi": indicators.add_rsi,
    "wilder": indicators.add_rsi_wilder,
    "atr": indicators.add_atr,
    "adx": indicators.add_adx,
    "macd": indicators.add_macd,
    "bbands": indicators.add_bbands,
    "stochastic": indicators.add_stochastic,
    "vwap": indicators.add_vwap,
    "supertrend": indicators.add_supertrend,
    "volume": indicators.add_volume_flags,
    "basic": indicators.add_basic_indicators,
    "ma_rsi": signals.ma_rsi_signals,
    "crosses": signals.ema_cross_signals,
    "orderblocks": patterns.detect_orderblocks,
    "gaps": patterns.detect_fvg,
    "fvg": lambda d: signals.fvg_signals(d, volume_filter=True),
}


@pytest.fixture(scope="module")
def candles(spark):
    return spark.createDataFrame(tables.candles(spark, SF).toPandas(), tables.candles(spark, SF).schema)


def frame(df):
    pdf = df.toPandas()
    return pdf.sort_values([c for c in ("symbol", "bar_idx", "bos_bar_idx", "type") if c in pdf]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ADDED))
def test_block_size_does_not_matter(candles, monkeypatch, name):
    whole = frame(ADDED[name](candles))
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 23)
    pd.testing.assert_frame_equal(frame(ADDED[name](candles)), whole, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(ADDED))
def test_no_window_over_a_whole_symbol(candles, name):
    plan = ADDED[name](candles)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    over = re.findall(r"Window .*?\], \[(.*?)\], \[(.*?)\]", plan)
    assert over
    for keys, order in over:  # the table of blocks may be read by symbol, ordered by block; gaps compete within an entry bar
        assert "__block" in keys or order.startswith("__block") or "entry_bar" in keys, (keys, order)


def test_nulls_are_no_steps(spark):
    values = [None, None, 4.0, 8.0, None, 2.0, 6.0] * 6
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "symbol string, bar_idx long, close double")
    got = [r["e"] for r in indicators.add_emas(df, {"e": 3}).orderBy("bar_idx").collect()]
    want, y = [], None
    for v in values:
        y = y if v is None else v if y is None else (y + v) / 2
        want.append(y)
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for a, b in zip(got, want))


@pytest.mark.parametrize("backwards", [False, True])
def test_running(spark, backwards):
    rows = [(None if i % 3 == 0 else f"k{i % 2}", i, float((i * 7) % 11) if i % 4 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    out = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "at": ("last", F.col("v"))}
    got = {r["i"]: r for r in blocks.running(df, out, ["i"], F.expr("i div 4"), ["k"], backwards).collect()}
    assert len(got) == 90
    for k, i, _ in rows:
        met = [v for k2, j, v in rows if k2 == k and v is not None and (j >= i if backwards else j <= i)]
        last = (met[0] if backwards else met[-1]) if met else None
        assert (got[i]["s"] or 0.0, got[i]["n"], got[i]["hi"], got[i]["lo"], got[i]["at"]) == (sum(met), len(met), max(met, default=None), min(met, default=None), last)


def test_equity_in_blocks(spark, monkeypatch):
    from barline.operators import metrics

    t = tables.trades(spark, SF).cache()
    by_exit = metrics.equity_curve(t, 1000.0).toPandas().sort_values(["symbol", "exit_time", "id"]).reset_index(drop=True)
    grown = by_exit.groupby("symbol")["pnl"].cumsum() + 1000.0
    assert (by_exit["equity"] - grown).abs().max() < 1e-9 and (by_exit["peak"] - grown.groupby(by_exit["symbol"]).cummax()).abs().max() < 1e-9
    assert (by_exit["n"] == by_exit.groupby("symbol").cumcount() + 1).all()
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 3)
    monkeypatch.setattr(metrics, "month", lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 7200))
    for order in (("id",), ("exit_time", "id")):
        got = metrics.equity_curve(t, 1000.0, order=order).toPandas().sort_values(["symbol", *order]).reset_index(drop=True)
        assert (got["peak"] - (got.groupby("symbol")["pnl"].cumsum() + 1000.0).groupby(got["symbol"]).cummax()).abs().max() < 1e-9


def test_asof_across_empty_days(spark):
    from barline.operators import joins

    candles = spark.sql("select 's' as symbol, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int), 12, 0, 0) as datetime, id as bar_idx from range(40)")
    quotes = spark.sql("select 's' as symbol, timestamp_ntz'2024-01-03 00:00:00' as ts, 1.0D as bid, cast(null as double) as ask union all select 's', timestamp_ntz'2024-01-20 12:00:00', 2.0D, 3.0D union all select 's', timestamp_ntz'2024-01-30 13:00:00', cast(null as double), 4.0D")
    got = [(r["bar_idx"], r["bid"], r["ask"]) for r in joins.asof_quotes(candles, quotes).orderBy("bar_idx").collect()]
    assert got == [(i, None if i < 2 else 1.0 if i < 19 else 2.0, None if i < 19 else 3.0 if i < 30 else 4.0) for i in range(40)]
    events = spark.sql("select 's' as symbol, timestamp_ntz'2023-11-01 00:00:00' as ts, 0 as e union all select 's', timestamp_ntz'2024-01-05 00:00:00', 1 union all select 's', timestamp_ntz'2024-04-01 00:00:00', 2 union all select 't', timestamp_ntz'2024-04-01 00:00:00', 3")
    near = {r["e"]: r["nearest"] and (r["nearest"].month, r["nearest"].day) for r in joins.nearest(events, candles).collect()}
    assert near == {0: (1, 1), 1: (1, 4), 2: (2, 9), 3: None}


def test_exact_quantiles(spark):
    from barline.operators import metrics

    small = spark.createDataFrame([("a", float(v)) for v in (3, 1, 2, 2, 2, 9, 5)] + [("b", 4.0), ("c", None)] + [("d", float(i % 3)) for i in range(1000)], "symbol string, v double")
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    want = {r["symbol"]: r["q"] for r in small.groupBy("symbol").agg(F.percentile("v", F.array(*[F.lit(x) for x in at])).alias("q")).collect() if r["q"]}
    for pieces in (2, 256):
        assert {r["symbol"]: r["q"] for r in metrics.exact_quantiles(small, F.col("v"), at, pieces=pieces).collect()} == want
    n = 10_000_000  # one key, all values different
    large = spark.range(n).select(F.lit("x").alias("symbol"), ((F.col("id") * 7919) % n).alias("v"))
    r = metrics.exact_quantiles(large, F.col("v"), (0.25, 0.5)).first()
    assert r["n"] == n and r["q"] == [(n - 1) / 4, (n - 1) / 2]
