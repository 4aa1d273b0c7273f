"""Readers, writers and streaming jobs on small files."""

import json
import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import formatting
from barline.operators import candles as C
from barline.operators import joins, ledger, orderbook
from barline.sources import readers, writers
from barline.streaming import live


def test_kline_archive(spark, tmp_path):
    d = tmp_path / "BTCUSDT" / "1h"
    d.mkdir(parents=True)
    row = lambda t: f"{t},1,2,0.5,1.5,10,{t + 1},0,1,0,0,x"
    (d / "m1.csv").write_text("\n".join([row(0), row(1704067200000), row(32503680000000)]))
    (d / "m2.csv").write_text(row(1706745600000))
    got = readers.read_kline_archive(spark, str(d)).orderBy("datetime").collect()
    assert [(r["symbol"], r["datetime"], r["close"]) for r in got] == [("BTCUSDT", datetime(2024, 1, 1), 1.5), ("BTCUSDT", datetime(2024, 2, 1), 1.5)]
    assert readers.read_ohlcv(spark, str(d), "X", datetime(2024, 1, 15), datetime(2024, 3, 1)).count() == 1


def test_ledger_csv_with_bad_cells(spark, tmp_path):
    names = "id,open_time,close_time,symbol,side,entry_raw,entry_exec,close_raw,close_exec,quantity,notional_entry_exec,notional_close_exec,commission_usdt,pnl_mid,pnl_exec"
    (tmp_path / "t.csv").write_text("\n".join([names, "1,,,S,buy,10,,12,,,,,,,", "2,,,S,short,10,10,12,12,2,,,,,x", "3,,,S,buy,1,1,1,1,0,,,,,7.5"]))
    rows = readers.read_live_ledger(spark, str(tmp_path / "t.csv"))
    assert [r["pnl"] for r in ledger.realized_pnl(rows).orderBy("id").collect()] == [2.0, -4.0, 7.5]


MESSAGES = [
    {"data": {"e": "kline", "s": "S", "E": 1000, "k": {"t": 0, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "9", "x": True}}},
    {"data": {"e": "bookTicker", "s": "S", "E": 900, "b": "1.4", "a": "1.6"}},
    {"data": {"e": "aggTrade", "s": "S", "p": "1.5", "q": "2", "T": 950}},
    {"e": "depthUpdate", "s": "S", "E": 1000, "b": [["1.4", "3"], ["1.3", "1"]], "a": [["1.6", "2"]]},
    {"data": {"e": "kline", "s": "S"}},
    {"data": {}},
    {"other": 1},
]


def test_messages_are_routed(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n".join([*map(json.dumps, MESSAGES), "not json"]))
    m = readers.read_messages(spark, str(tmp_path), stream=False).cache()
    assert [r["close"] for r in readers.klines(m).collect()] == [1.5]
    assert [(r["bid"], r["ask"]) for r in readers.quotes(m).collect()] == [(1.4, 1.6)]
    assert [r["qty"] for r in readers.prints(m).collect()] == [2.0]
    book = orderbook.depth(orderbook.levels(readers.books(m))).orderBy("side", "level").collect()
    assert [(r["side"], r["price"], r["cum_qty"]) for r in book] == [("ask", 1.6, 2.0), ("bid", 1.4, 3.0), ("bid", 1.3, 4.0)]
    empty = readers.books(m).withColumn("asks", F.expr("array()").cast("array<array<string>>"))
    assert orderbook.best_prices(orderbook.levels(empty)).first()["mid"] is None


def run(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def ticks(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("A" if i % 2 else "B", t0 + timedelta(minutes=i), 100.0 + (i * 37 % 11), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, qty double")
    df.write.parquet(str(tmp_path / "ticks"))
    end = spark.createDataFrame([("A", t0 + timedelta(days=9), 1.0, 1.0)], df.schema)
    end.write.mode("append").parquet(str(tmp_path / "ticks"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "ticks"))


def test_stream_bars_equal_batch(spark, tmp_path):
    batch, stream = ticks(spark, tmp_path)
    got = {tuple(r) for r in run(live.bars(stream), spark, "bars").filter("datetime < '2024-01-05'").collect()}
    assert got == {tuple(r) for r in C.from_ticks(batch).collect()}


def bars_frame(n=160):
    t0 = datetime(2024, 1, 1)
    out, c = [], 100.0
    for i in range(n):
        o, c = c, 100.0 + 9 * math.sin(i / 9) + ((i * 7919) % 13 - 6) / 6
        out.append(("S", t0 + timedelta(minutes=15 * i), o, max(o, c) + 0.4, min(o, c) - 0.4, c, 5.0))
    return out


CANDLES = "symbol string, datetime timestamp, open double, high double, low double, close double, volume double"


def test_live_trader_equals_batch_rules(spark, tmp_path):
    rows = bars_frame()
    df = spark.createDataFrame(rows, CANDLES)
    df.write.parquet(str(tmp_path / "bars"))
    generate = live.ma_rsi_last()
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "bars"))
    got = run(live.live_trader(stream, generate, least=30), spark, "trader").collect()
    pdf = pd.DataFrame(rows, columns=CANDLES.replace(" string", "").replace(" timestamp", "").replace(" double", "").split(", "))
    pdf["signal"] = [generate(pdf.iloc[: i + 1]).get("signal", 0) if i + 1 >= 30 else 0 for i in range(len(pdf))]
    want = ledger.live_rule_ledger(spark.createDataFrame(pdf)).collect()
    events = lambda rs: sorted((r["datetime"], r["event"], r["side"], round(r["quantity"], 9), round(r["balance"], 6)) for r in rs if r["event"] != "equity")
    assert len(want) > 2 and events(got) == events(want)
    assert sum(r["event"] == "equity" for r in got) == len(rows)


def test_live_gap_rule_equals_batch(spark):
    from barline.operators import signals

    rows = bars_frame(400)
    df = C.with_bar_idx(spark.createDataFrame(rows, CANDLES))
    batch = {r["bar_idx"]: (r["signal"], round(r["stop_price"], 9), round(r["take_price"], 9)) for r in signals.fvg_signals(df).filter("signal <> 0").collect()}
    pdf = df.orderBy("bar_idx").toPandas()
    generate = live.fvg_last()
    mine = {}
    for i in range(5, len(pdf)):
        s = generate(pdf.iloc[: i + 1].reset_index(drop=True))
        if s:
            mine[i] = (s["signal"], round(s["stop_price"], 9), round(s["take_price"], 9))
    assert batch and mine == batch


def test_quotes_reach_bars(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("S", t0, 1, 10.0, None, None), ("S", t0 + timedelta(minutes=1), 0, None, 9.0, 11.0), ("S", t0 + timedelta(minutes=2), 1, 10.5, None, None)]
    schema = "symbol string, datetime timestamp, kind int, close double, bid double, ask double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "q")).schema).parquet(str(tmp_path / "q"))
    got = [(r["close"], r["bid"], r["ask"]) for r in run(live.quoted_bars(stream), spark, "quoted").orderBy("datetime").collect()]
    assert got == [(10.0, None, None), (10.5, 9.0, 11.0)]


def test_upsert_sink_and_feeds(spark, tmp_path):
    sink = writers.upsert_sink(str(tmp_path / "t"), ["symbol"], "update_seq")
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, v double, update_seq long")
    sink(frame([("A", 1.0, 1), ("B", 1.0, 1), ("A", 2.0, 2)]), 0)
    sink(frame([("A", 3.0, 3)]), 1)
    sink(frame([("A", 3.0, 3)]), 1)  # a batch that is tried again
    assert {(r["symbol"], r["v"]) for r in writers.latest(spark, str(tmp_path / "t")).collect()} == {("A", 3.0), ("B", 1.0)}
    writers.write_feeds({"x": frame([("A", float("nan"), 1), ("B", float("inf"), 2)])}, str(tmp_path / "f"))
    assert "v" not in "".join(p.read_text() for p in (tmp_path / "f" / "x").glob("*.json"))


def test_texts(spark):
    r = spark.createDataFrame([(1234.5, -2.0)], "a double, b double").select(formatting.money(F.col("a")), formatting.money_plain(F.col("a")), formatting.signed_percent(F.col("b")), formatting.signed_percent(F.col("a"))).first()
    assert tuple(r) == ("1.234,50", "1,234.50", "-2.00%", "+1234.50%")


@pytest.mark.parametrize("tf, want", [("1H", "1h"), ("h1", "1h"), (" 15M ", "15m"), ("d1", "1d"), ("odd", "odd")])
def test_timeframes(tf, want):
    assert C.normalize_timeframe(tf) == want


def test_next_unseen_starts_over(spark):
    t = spark.createDataFrame([("S", i) for i in range(3)], "symbol string, id long")
    assert joins.next_unseen(t, t.filter("id <> 1")).first()["id"] == 1
    assert joins.next_unseen(t, t).count() == 1


def test_stale(spark):
    df = spark.createDataFrame([("S", datetime(2024, 1, 1)), ("T", datetime(2024, 1, 1, 0, 5))], "symbol string, datetime timestamp")
    got = {r["symbol"]: r["stale"] for r in live.staleness(df, datetime(2024, 1, 1, 0, 6)).collect()}
    assert got == {"S": True, "T": False}


def test_upsert_touches_only_its_parts(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    sink = writers.upsert_sink(str(path), ["k"], "seq", parts=8)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v double, seq long")
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.glob("data/*/*/*.parquet")}
    sink(frame([(f"k{i}", 0.0, i) for i in range(100)]), 0)
    first = files()
    assert len(first) == 8
    with monkeypatch.context() as m:  # the batch dies between its data and its manifest
        m.setattr(writers, "_clean", lambda *a: None)
        named = spark.createDataFrame
        m.setattr(type(spark), "createDataFrame", lambda self, rows, schema: (_ for _ in ()).throw(RuntimeError("lost")) if "at long" in str(schema) else named(rows, schema))
        with pytest.raises(RuntimeError):
            sink(frame([("k1", 1.0, 1000)]), 1)
    assert {r["v"] for r in writers.latest(spark, str(path)).collect()} == {0.0}
    for _ in range(2):  # tried again, twice
        sink(frame([("k1", 1.0, 1000), ("k1", -1.0, 999)]), 1)
        got = {r["k"]: r["v"] for r in writers.latest(spark, str(path)).collect()}
        assert len(got) == 100 and got["k1"] == 1.0 and sum(got.values()) == 1.0
    second = files()
    assert first.items() <= second.items() and len(second) == 9  # old files stay as they were for readers; one part is new
    sink(frame([("k1", 2.0, 1001), ("new", 5.0, 1002)]), 2)
    third = files()
    assert len(set(first) - set(third)) == 1 and len(writers.latest(spark, str(path)).collect()) == 101
    assert all(third[f] == t for f, t in first.items() if f in third)
    sink(frame([]), 3)
    assert len(writers.latest(spark, str(path)).collect()) == 101 and writers.latest(spark, str(tmp_path / "none")) is None


def test_upsert_stream(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "k string, v double, seq long")
    for n in range(3):
        frame([(f"k{i}", float(n), 10 * n + i) for i in range(n, 5)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v double, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(writers.upsert_sink(str(tmp_path / "t"), ["k"], "seq", parts=2)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["k"], r["v"]) for r in writers.latest(spark, str(tmp_path / "t")).collect()} == {("k0", 0.0), ("k1", 1.0), ("k2", 2.0), ("k3", 2.0), ("k4", 2.0)}


def test_corrected_bars(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "symbol string, datetime timestamp, close double, is_closed boolean, event_time timestamp"
    bar = lambda i, close, closed, sec: ("S", t0 + timedelta(minutes=15 * i), close, closed, t0 + timedelta(minutes=15 * i, seconds=sec))
    batches = [[bar(0, 1.0, True, 900), bar(1, 5.0, False, 910)], [bar(0, 2.0, True, 960), bar(0, 1.5, True, 930)], [bar(40, 9.0, True, 900)], [bar(41, 9.5, True, 900)], [bar(0, 7.0, True, 999), bar(42, 9.5, True, 900)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "b" / str(n)))
    for n in range(len(batches)):
        (tmp_path / "in").mkdir(exist_ok=True)
        for k, p in enumerate((tmp_path / "b" / str(n)).glob("*.parquet")):
            p.rename(tmp_path / "in" / f"{n}-{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r["datetime"], r["close"]) for r in run(live.closed_bars(stream, "1 hour"), spark, "corrected").collect()]
    assert got == [(t0, 2.0)]  # the last correction in time; what comes after the watermark is too late, later bars are still open


def test_ticks_of_a_closed_bar_wait(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    ms = lambda n: t0 + timedelta(milliseconds=n)
    candle = lambda at, close, closed: ("S", ms(at), 0, t0, 1.0, 3.0, 0.5, close, 9.0, closed, None)
    tick = lambda at, price: ("S", ms(at), 1, None, None, None, None, None, None, None, price)
    schema = "symbol string, ts timestamp, kind int, datetime timestamp, open double, high double, low double, close double, volume double, is_closed boolean, price double"
    rows = [tick(0, 2.0), candle(10, 2.0, False), tick(20, 4.0), tick(120, 9.0), tick(221, 0.1), candle(300, 2.5, True), tick(900, 8.0), candle(1000, 2.0, False), tick(1300, 2.2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "t"))
    got = [(r["is_tick"], r["high"], r["low"], r["close"]) for r in run(live.forming_candles(stream), spark, "gate").collect()]
    assert got == [(False, 3.0, 0.5, 2.0), (True, 4.0, 0.5, 4.0), (True, 3.0, 0.1, 0.1), (False, 3.0, 0.5, 2.5), (False, 3.0, 0.5, 2.0), (True, 3.0, 0.5, 2.2)]


def test_intrabar_signals_equal_batch(spark, tmp_path):
    """Every tick's signal is that of the batch rule over the bars as they stood."""
    rows, events, standing = bars_frame(60), [], []
    generate = live.ma_rsi_last()
    want = []
    for i, (s, at, o, h, l, c, v) in enumerate(rows):
        for k, close in enumerate((o, (h + l) / 2, c)):
            events.append((s, at, close, k == 2, at + timedelta(minutes=k)))
            frame = pd.DataFrame({"close": [*standing, close]})
            want.append((at, close, generate(frame).get("signal", 0)))
        standing.append(c)
    schema = "symbol string, datetime timestamp, close double, is_closed boolean, event_time timestamp"
    (tmp_path / "in").mkdir()
    for n, part in enumerate((events[:70], events[70:])):  # state goes from one micro-batch to the next
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r["datetime"], r["close"], r["signal"]) for r in run(live.intrabar_signals(stream), spark, "intrabar").collect()]
    assert sorted(got) == sorted(want) and {s for _, _, s in got} == {-1, 0, 1}
