"""Streaming: ticks to bars, throttles, latest books, and one stateful job per symbol.

State is bounded: windows by the watermark, the stateful jobs by a buffer of
bars and one position per symbol. They need the RocksDB state store.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barline import ship
from barline.functions.position import LedgerState, step
from barline.operators.candles import tick_aggregates

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def bars(ticks: DataFrame, timeframe: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling bars: in append mode closed bars, in update mode the forming ones too."""
    w = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", timeframe).alias("w"))
    b = w.agg(*tick_aggregates(ticks))
    return b.select("symbol", F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume")


def closed_bars(events: DataFrame, late: str = "1 hour", seq: str = "event_time") -> DataFrame:
    """Closed candle events, the last version of each (by ``seq``, where there is that column), once the watermark has passed.

    A correction that comes within ``late`` replaces what came before it. State:
    one row per open (symbol, datetime).
    """
    names = [c for c in events.columns if c not in ("symbol", "datetime")]
    newest = F.struct(*([seq] if seq in names else []), *[c for c in names if c != seq])
    last = events.filter("is_closed").withWatermark("datetime", late).groupBy("symbol", "datetime").agg(F.max(newest).alias("b"))
    return last.select(*[c if c in ("symbol", "datetime") else F.col("b")[c].alias(c) for c in events.columns])


def throttled(ticks: DataFrame, every: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """At most one tick per symbol and interval of event time, the last."""
    w = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w"))
    return w.agg(F.max("ts").alias("ts"), F.max_by("price", F.struct("ts", "price")).alias("price")).select("symbol", "ts", "price")


def latest_books(books: DataFrame) -> DataFrame:
    """The latest snapshot per symbol; for update or complete mode."""
    last = F.max_by(F.struct("snapshot_ts", "bids", "asks"), "snapshot_ts").alias("b")
    return books.groupBy("symbol").agg(last).select("symbol", "b.*")


def staleness(bars: DataFrame, now, limit_s: int = 180) -> DataFrame:
    """Batch form of the watch: seconds since the last bar per symbol, and whether it is stale."""
    last = bars.groupBy("symbol").agg(F.max("datetime").alias("last_bar"), F.count("*").alias("bars"))
    age = F.timestamp_diff("SECOND", F.col("last_bar"), F.lit(now).cast("timestamp"))
    return last.withColumn("age_s", age).withColumn("stale", F.col("age_s") > limit_s)


class QuotedBars(StatefulProcessor):
    """Bars (kind 1) with the latest quote (kind 0) before them; state: bid and ask."""

    SCHEMA = "symbol string, datetime timestamp, close double, bid double, ask double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quote = handle.getValueState("quote", "bid double, ask double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["datetime", "kind"], kind="stable")
        bid, ask = self.quote.get() if self.quote.exists() else (None, None)
        out = []
        for r in frame.itertuples(index=False):
            if r.kind == 0:
                bid, ask = r.bid, r.ask
            else:
                out.append((key[0], r.datetime, r.close, bid, ask))
        if bid is not None:
            self.quote.update((float(bid), float(ask)))
        yield pd.DataFrame(out, columns=["symbol", "datetime", "close", "bid", "ask"])

    def close(self) -> None:
        pass


def quoted_bars(rows: DataFrame) -> DataFrame:
    """``rows``: symbol, datetime, kind, close, bid, ask (the union of quotes and bars)."""
    ship(rows.sparkSession)
    return rows.groupBy("symbol").transformWithStateInPandas(QuotedBars(), outputStructType=QuotedBars.SCHEMA, outputMode="Append", timeMode="None")


class TickGate(StatefulProcessor):
    """The forming candle as ticks move it, at most one row per ``every_ms``; ticks after its close wait for the next candle.

    State: the last candle event of a symbol, and when a tick last went through.
    """

    SCHEMA = "symbol string, datetime timestamp, open double, high double, low double, close double, volume double, is_closed boolean, is_tick boolean"
    NAMES = ["datetime", "open", "high", "low", "close", "volume", "is_closed"]

    def __init__(self, every_ms: int = 200):
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.candle = handle.getValueState("candle", "datetime timestamp, open double, high double, low double, close double, volume double, is_closed boolean")
        self.emitted = handle.getValueState("emitted", "ms double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        candle = list(self.candle.get()) if self.candle.exists() else None
        emitted = self.emitted.get()[0] if self.emitted.exists() else -math.inf
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "kind"], kind="stable").itertuples(index=False):
            at = r.ts.timestamp() * 1000
            if r.kind == 0:
                candle = [r.datetime, *map(float, (r.open, r.high, r.low, r.close, r.volume)), bool(r.is_closed)]
                out.append((key[0], *candle, False))
            elif candle is not None and not candle[-1] and at - emitted > self.every_ms:
                emitted = at
                out.append((key[0], candle[0], candle[1], max(candle[2], r.price), min(candle[3], r.price), float(r.price), candle[5], False, True))
        if candle is not None:
            self.candle.update(tuple(candle))
        if emitted > -math.inf:
            self.emitted.update((emitted,))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in self.SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def forming_candles(rows: DataFrame, every_ms: int = 200) -> DataFrame:
    """``rows``: symbol, ts (event time), kind (0 candle event, 1 tick), the candle's columns with is_closed, price."""
    ship(rows.sparkSession)
    return rows.groupBy("symbol").transformWithStateInPandas(TickGate(every_ms), outputStructType=TickGate.SCHEMA, outputMode="Append", timeMode="None")


class IntrabarSignals(StatefulProcessor):
    """The moving-average and RSI rule on every candle event, the forming bar counting as the last one.

    State: the closes that the rule needs, the last of them provisional: an
    event of the same bar replaces it, one of a later bar adds to it, one of an
    earlier bar corrects that bar if it is still held.
    """

    SCHEMA = "symbol string, datetime timestamp, close double, is_closed boolean, signal int"

    def __init__(self, short: int = 9, long: int = 21, period: int = 14, buy: float = 55.0, sell: float = 45.0):
        self.short, self.long, self.period, self.buy, self.sell = short, long, period, buy, sell
        self.size = max(long, period) + 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closes = handle.getListState("closes", "datetime timestamp, close double")

    def rule(self, closes: list[float]) -> int:
        if len(closes) < self.size:
            return 0
        changes = [b - a for a, b in zip(closes[-self.period - 1 : -1], closes[-self.period :])]
        gain, loss = sum(max(c, 0.0) for c in changes), sum(max(-c, 0.0) for c in changes)
        rsi = 100 - 100 / (1 + gain / loss) if loss > 0 else 50.0
        a, b = sum(closes[-self.short :]) / self.short, sum(closes[-self.long :]) / self.long
        return 1 if a > b and rsi > self.buy else -1 if a < b and rsi < self.sell else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = {at: close for at, close in self.closes.get()} if self.closes.exists() else {}
        out = []
        for r in pd.concat(list(rows)).sort_values("event_time", kind="stable").itertuples(index=False):
            at = r.datetime.to_pydatetime()
            if held and at < min(held) and len(held) == self.size:
                continue
            held[at] = float(r.close)
            held = dict(sorted(held.items())[-self.size :])
            out.append((key[0], at, float(r.close), bool(r.is_closed), self.rule(list(held.values()))))
        if held:
            self.closes.put(list(held.items()))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in self.SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def intrabar_signals(candles: DataFrame, **options) -> DataFrame:
    """``candles``: symbol, datetime, close, is_closed, event_time; a row with its signal per event."""
    ship(candles.sparkSession)
    return candles.groupBy("symbol").transformWithStateInPandas(IntrabarSignals(**options), outputStructType=IntrabarSignals.SCHEMA, outputMode="Append", timeMode="None")


Generate = Callable[[pd.DataFrame], dict]


class LiveTrader(StatefulProcessor):
    """Signals from the buffered bars, stops, position and equity in one step per closed bar.

    ``generate`` gets the buffer (at most ``buffer`` bars, ``least`` or more) and
    returns signal, stop_price and take_price of its last bar.
    """

    SCHEMA = "symbol string, datetime timestamp, event string, side string, quantity double, entry_price double, exit_price double, pnl double, reason string, balance double, equity double"
    BAR = "datetime timestamp, open double, high double, low double, close double, volume double"

    def __init__(self, generate: Generate, buffer: int = 1000, least: int = 100, balance: float = 1000.0, risk_percent: float = 1.0, fee: float = 0.0004, slip: float = 0.0):
        self.generate, self.size, self.least = generate, buffer, least
        self.balance, self.risk_percent, self.fee, self.slip = balance, risk_percent, fee, slip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", self.BAR)
        self.position = handle.getValueState("position", "balance double, side int, quantity double, entry double, stop double, take double")

    def handleInitialState(self, key, history: pd.DataFrame, timers) -> None:
        """Warm start: history fills the buffer before the first live bar."""
        rows = history.sort_values("datetime").tail(self.size)
        self.bars.put([tuple(r) for r in rows[["datetime", "open", "high", "low", "close", "volume"]].itertuples(index=False)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = list(self.bars.get()) if self.bars.exists() else []
        state = LedgerState(*self.position.get()) if self.position.exists() else LedgerState(self.balance)
        out = []
        names = ["datetime", "open", "high", "low", "close", "volume"]
        for bar in pd.concat(list(rows)).sort_values("datetime")[names].itertuples(index=False):
            held = [*held, tuple(bar)][-self.size :]
            act = self.generate(pd.DataFrame(held, columns=names)) if len(held) >= self.least else {}
            now = _Bar(key[0], *bar, None, None, int(act.get("signal", 0)), act.get("stop_price"), act.get("take_price"))
            state, events = step(state, now, self.risk_percent, self.fee, self.slip)
            out.extend((e[0], e[2], e[1], *e[3:]) for e in events)
            open_pnl = (now.close - state.entry) * state.quantity * state.side
            out.append((key[0], now.datetime, "equity", None, None, None, None, open_pnl, None, state.balance, state.balance + open_pnl))
        self.bars.put(held)
        self.position.update((state.balance, state.side, state.quantity, state.entry, state.stop, state.take))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in self.SCHEMA.split(", ")])

    def close(self) -> None:
        pass


class _Bar:
    __slots__ = ("symbol", "datetime", "open", "high", "low", "close", "volume", "bid", "ask", "signal", "stop_price", "take_price")

    def __init__(self, *values):
        for name, value in zip(self.__slots__, values):
            setattr(self, name, value)


def live_trader(bars: DataFrame, generate: Generate, history: DataFrame | None = None, **options) -> DataFrame:
    """Open, close and equity events per closed bar; ``history`` warms the buffers up."""
    ship(bars.sparkSession)
    initial = history.groupBy("symbol") if history is not None else None
    return bars.groupBy("symbol").transformWithStateInPandas(LiveTrader(generate, **options), outputStructType=LiveTrader.SCHEMA, outputMode="Append", timeMode="None", initialState=initial)


def ma_rsi_last(short: int = 9, long: int = 21, period: int = 14, buy: float = 55.0, sell: float = 45.0) -> Generate:
    """The moving-average and RSI rule for the last bar of a buffer."""

    def generate(pdf: pd.DataFrame) -> dict:
        close = pdf["close"].tail(max(long, period) + 2)
        if len(close) < max(long, period) + 2:
            return {}
        change = close.diff().fillna(0.0).tail(period)
        gain, loss = change.clip(lower=0).mean(), -change.clip(upper=0).mean()
        rsi = 100 - 100 / (1 + gain / loss) if loss > 0 else 50.0
        a, b = close.tail(short).mean(), close.tail(long).mean()
        return {"signal": 1 if a > b and rsi > buy else -1 if a < b and rsi < sell else 0}

    return generate


def fvg_last(reward: float = 3.0, max_age: int = 100, min_risk_atr: float = 0.25, tolerance: float = 1e-6, filter_percent: float = 0.5) -> Generate:
    """The gap-retest rule for the last bar of a buffer; other bars' signals are not looked for."""

    def generate(pdf: pd.DataFrame) -> dict:
        high, low, close = (pdf[c].to_numpy() for c in ("high", "low", "close"))
        n = len(pdf)
        ema = pdf["close"].ewm(span=50, adjust=False).mean().to_numpy()
        before = pdf["close"].shift(1)
        ranges = pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - before).abs(), (pdf["low"] - before).abs()], axis=1).max(axis=1)
        atr = ranges.rolling(14).mean().to_numpy()
        for base in range(max(3, n - 1 - max_age), n - 1):
            for side, top, bottom in ((1, low[base], high[base - 2]), (-1, low[base - 2], high[base])):
                if side > 0:
                    open_ = high[base - 2] < low[base] and high[base - 2] < high[base - 1] and low[base - 2] < low[base]
                else:
                    open_ = low[base - 2] > high[base] and low[base - 2] > low[base - 1] and high[base - 2] > high[base]
                if not open_ or top == 0 or (top - bottom) / top * 100 <= filter_percent or side * close[base] <= side * ema[base]:
                    continue
                mid = (top + bottom) / 2
                touched = (low[base + 1 :] - mid * tolerance <= mid) & (mid <= high[base + 1 :] + mid * tolerance)
                if not touched[-1] or touched[:-1].any() or side * close[-1] <= side * ema[-1]:
                    continue
                stop = low[base - 2 : base + 2].min() if side > 0 else high[base - 2 : base + 2].max()
                risk = side * (mid - stop)
                if risk <= 0 or risk < min_risk_atr * atr[base]:
                    continue
                return {"signal": side, "stop_price": float(stop), "take_price": float(mid + side * reward * risk)}
        return {}

    return generate


class StaleWatch(StatefulProcessor):
    """Emits a symbol when no bar has come for ``limit_ms`` of processing time, and counts its bars."""

    SCHEMA = "symbol string, bars long, stale boolean"

    def __init__(self, limit_ms: int = 180_000):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "bars long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        n = sum(len(r) for r in rows) + (self.seen.get()[0] if self.seen.exists() else 0)
        self.seen.update((n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.limit_ms)
        yield pd.DataFrame({"symbol": [key[0]], "bars": [n], "stale": [False]})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"symbol": [key[0]], "bars": [self.seen.get()[0]], "stale": [True]})

    def close(self) -> None:
        pass


def stale_watch(bars: DataFrame, limit_ms: int = 180_000) -> DataFrame:
    ship(bars.sparkSession)
    return bars.groupBy("symbol").transformWithStateInPandas(StaleWatch(limit_ms), outputStructType=StaleWatch.SCHEMA, outputMode="Append", timeMode="ProcessingTime")
