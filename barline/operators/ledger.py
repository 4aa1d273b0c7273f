"""Trade ledgers from signals: pairing, single position, compounding, hedge, live rules."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline import ship
from barline.functions.blocks import bar_block, positions
from barline.functions.frames import holds, over_zero
from barline.functions.position import LedgerState, step
from barline.functions.recurrence import linear_recurrence
from barline.scratch import materialize


def exec_buy(bid: Column, ask: Column, mid: Column, fee: float, slip: float) -> Column:
    return F.coalesce(ask, mid) * (1 + slip) * (1 + fee)


def exec_sell(bid: Column, ask: Column, mid: Column, fee: float, slip: float) -> Column:
    return F.coalesce(bid, mid) * (1 - slip) * (1 - fee)


def position_size(balance: Column, risk_percent: float, price: Column) -> Column:
    return balance * (risk_percent / 100.0) / over_zero(price)


def stop_size(capital: Column, risk_percent: float, price: Column, stop: Column, fallback: Column) -> Column:
    """capital * risk% / |price - stop|; without a usable stop, the fallback."""
    return F.coalesce(capital * (risk_percent / 100.0) / over_zero(F.abs(price - stop)), fallback) if risk_percent > 0 else fallback


def ledger_costs(trades: DataFrame, fee: float) -> DataFrame:
    """Adds notionals, the commission on both sides and pnl_mid by side."""
    into, out = F.col("entry_exec") * F.col("quantity"), F.col("close_exec") * F.col("quantity")
    mid = F.when(F.lower("side").isin("buy", "long"), F.col("close_raw") - F.col("entry_raw")).otherwise(F.col("entry_raw") - F.col("close_raw"))
    return trades.withColumns({"notional_entry_exec": into, "notional_close_exec": out, "commission_usdt": (into + out) * fee, "pnl_mid": mid * F.col("quantity")})


def realized_pnl(trades: DataFrame, zero_quantity_is_one: bool = False) -> DataFrame:
    """Adds ``pnl`` from text columns: pnl_exec, else (exit - entry) * quantity by side.

    Blank or unreadable exec prices fall back to raw ones, a blank quantity to 1.
    """
    number = lambda c: F.expr(f"try_cast(nullif(trim({c}), '') as double)")
    entry, close = F.coalesce(number("entry_exec"), number("entry_raw")), F.coalesce(number("close_exec"), number("close_raw"))
    quantity = F.coalesce(over_zero(number("quantity")) if zero_quantity_is_one else number("quantity"), F.lit(1.0))
    sign = F.when(F.lower("side").isin("buy", "long"), 1).otherwise(-1)
    return trades.withColumn("pnl", F.coalesce(number("pnl_exec"), (close - entry) * quantity * sign))


def pair_trades(rows: DataFrame, keys=("symbol",)) -> DataFrame:
    """Alternating pairs: one non-zero signal enters, the next one, whatever its side, leaves."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    acts = rows.filter("signal <> 0").select(*keys, "bar_idx", "datetime", "signal", "close")
    acts = acts.withColumns({"__n": F.row_number().over(w), "exit_bar": F.lead("bar_idx").over(w), "exit_time": F.lead("datetime").over(w), "exit_price": F.lead("close").over(w)})
    pairs = acts.filter((F.col("__n") % 2 == 1) & F.col("exit_bar").isNotNull())
    pnl = F.when(F.col("signal") > 0, F.col("exit_price") - F.col("close")).otherwise(F.col("close") - F.col("exit_price"))
    return pairs.select(*keys, F.col("bar_idx").alias("entry_bar"), F.col("datetime").alias("entry_time"), "signal", F.col("close").alias("entry_price"), "exit_bar", "exit_time", "exit_price", pnl.alias("pnl"))


def pairing_summary(rows: DataFrame, initial: float = 1000.0, keys=("symbol",)) -> DataFrame:
    """equity_final, pnl, win_rate per key; keys without a pair keep the initial balance."""
    pairs = pair_trades(rows, keys).groupBy(*keys).agg(F.sum("pnl").alias("pnl"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count("*").alias("n"))
    out = rows.select(*keys).distinct().join(pairs, list(keys), "left")
    pnl = F.coalesce("pnl", F.lit(0.0))
    return out.select(*keys, (initial + pnl).alias("equity_final"), pnl.alias("pnl"), F.coalesce(F.col("wins") / F.col("n"), F.lit(0.0)).alias("win_rate"))


def _optional(rows: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in rows.columns else F.lit(None).cast("double")


def single_position_ledger(
    rows: DataFrame, initial: float = 1000.0, risk_percent: float = 0.0, commission: float = 0.0, slippage: float = 0.0, keys=("symbol",)
) -> DataFrame:
    """One trade per non-zero signal; ``rows`` are candles with signal and its optional columns.

    A trade lives on the bars after its entry up to the next signal. Each bar
    first widens the excursions, then raises a trailing stop with its close,
    then checks stop before target; a trade still open at the next signal leaves
    at its close, one open at the end at the last close. No state is needed:
    the trade of a bar is the number of signals strictly before it.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: _optional(rows, n) for n in ("entry_price", "stop_price", "take_price", "size", "risk", "trailing_distance")})
    sign = F.signum(F.col("signal").cast("double")).cast("int")
    price = F.coalesce("entry_price", "close")
    entry = F.struct(
        sign.alias("dir"), F.col("bar_idx").alias("entry_bar"), F.col("datetime").alias("entry_time"), price.alias("raw"), "stop_price", "take_price", "trailing_distance",
        F.coalesce("size", F.lit(1.0)).alias("base_size"), F.col("risk").alias("base_risk"), F.col("volume").alias("volume_at_entry"),
    )
    acts = F.col("signal") != 0
    rows = rows.withColumn("__n", F.coalesce(F.count_if(acts).over(before), F.lit(0)))
    entries = rows.filter(acts).select(*keys, F.col("__n").alias("id"), entry.alias("e"), F.col("close").alias("own_close"))
    alive = rows.withColumn("e", F.last(F.when(acts, entry), ignorenulls=True).over(before)).filter("e is not null").withColumn("id", F.col("__n") - 1)
    trade = Window.partitionBy(*keys, "id").orderBy("bar_idx")
    long = F.col("e.dir") > 0
    trail = F.when(long, F.max(F.col("close") - F.col("e.trailing_distance")).over(trade)).otherwise(F.min(F.col("close") + F.col("e.trailing_distance")).over(trade))
    stop = F.when(long, F.greatest("e.stop_price", trail)).otherwise(F.least("e.stop_price", trail))
    alive = alive.withColumn("stop", stop)
    sl = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    tp = F.when(long, F.col("high") >= F.col("e.take_price")).otherwise(F.col("low") <= F.col("e.take_price"))
    alive = alive.withColumn("reason", F.when(sl, "sl").when(tp, "tp"))
    over = F.coalesce(F.count("reason").over(trade.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alive = alive.withColumn("over", over).filter("over = 0")
    leave = F.struct(
        F.col("bar_idx").alias("exit_bar"), F.col("datetime").alias("exit_time"), F.coalesce("reason", F.when(acts, "signal"), F.lit("eod")).alias("exit_reason"),
        F.when(F.col("reason") == "sl", F.col("stop")).when(F.col("reason") == "tp", F.col("e.take_price")).otherwise(F.col("close")).alias("exit_raw"), F.col("stop").alias("stop"),
    )
    ends = alive.groupBy(*keys, "id").agg(F.max_by(leave, "bar_idx").alias("x"), F.max("high").alias("top"), F.min("low").alias("bottom"))
    t = entries.join(ends, [*keys, "id"], "left").select(*keys, "id", "e.*", "x.*", "top", "bottom", "own_close")
    t = t.withColumns(
        {
            "exit_bar": F.coalesce("exit_bar", "entry_bar"),
            "exit_time": F.coalesce("exit_time", "entry_time"),
            "exit_reason": F.coalesce("exit_reason", F.lit("eod")),
            "exit_raw": F.coalesce("exit_raw", "own_close"),
            "entry_px": F.col("raw") * (1 + F.col("dir") * slippage),
            "per_unit": over_zero(F.abs(F.col("raw") - F.col("stop_price"))),
        }
    )
    t = t.withColumn("exit_px", F.col("exit_raw") * (1 - F.col("dir") * slippage))
    unit = (F.col("exit_px") - F.col("entry_px")) * F.col("dir") - commission * (F.col("entry_px") + F.col("exit_px"))
    t = t.withColumn("unit_pnl", unit)
    if risk_percent > 0:
        share = F.lit(risk_percent / 100.0) / F.col("per_unit")
        a, b = F.when(share.isNotNull(), 1 + share * F.col("unit_pnl")).otherwise(1.0), F.when(share.isNull(), F.col("unit_pnl") * F.col("base_size")).otherwise(0.0)
        first = F.col("id") == 0
        t = linear_recurrence(t, F.when(first, 0.0).otherwise(a), F.when(first, a * initial + b).otherwise(b), "__after", keys, "id")
        capital = F.coalesce(F.lag("__after").over(Window.partitionBy(*keys).orderBy("id")), F.lit(initial))
        t = t.withColumn("__capital", capital)
        t = t.withColumn("size", F.coalesce(F.col("__capital") * share, "base_size")).withColumn("risk", F.coalesce(F.when(share.isNotNull(), F.col("__capital") * (risk_percent / 100.0)), "base_risk"))
    else:
        t = t.withColumn("size", F.col("base_size")).withColumn("risk", F.coalesce("base_risk", F.col("per_unit") * F.col("base_size")))
    best, worst = F.col("top") - F.col("entry_px"), F.col("bottom") - F.col("entry_px")
    favor = F.when(F.col("dir") > 0, best).otherwise(-worst) * F.col("size")
    adverse = F.when(F.col("dir") > 0, worst).otherwise(-best) * F.col("size")
    done = t.select(
        *keys, F.col("id").cast("long").alias("id"), F.when(F.col("dir") > 0, "long").otherwise("short").alias("direction"), "entry_time", F.col("entry_bar").alias("entry_bar_index"),
        F.col("entry_px").alias("entry_price"), "size", F.coalesce(F.when(F.col("trailing_distance").isNotNull(), F.col("stop")), "stop_price").alias("stop_price"), "take_price", "trailing_distance", "risk",
        F.greatest(F.coalesce(favor, F.lit(0.0)), F.lit(0.0)).alias("max_favor"), F.least(F.coalesce(adverse, F.lit(0.0)), F.lit(0.0)).alias("max_adverse"), "volume_at_entry",
        "exit_time", F.col("exit_bar").alias("exit_bar_index"), F.col("exit_px").alias("exit_price"), (F.col("unit_pnl") * F.col("size")).alias("pnl"),
        (commission * F.col("entry_px") * F.col("size")).alias("commission_open"), (commission * F.col("exit_px") * F.col("size")).alias("commission_close"), "exit_reason",
    )
    return derived(done)


def reversal_pnl(rows: DataFrame, commission: float = 0.0, slippage: float = 0.0, keys=("symbol",)) -> DataFrame:
    """pnl per trade where no trade has a stop or target: each ends at the next signal's close, the last at the last close.

    The single-position ledger's results for such signals, in one window.
    """
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    last = F.last("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one value per key
    acts = rows.select(*keys, "bar_idx", "signal", "close", last.alias("__last")).filter("signal <> 0")
    sign = F.signum(F.col("signal").cast("double"))
    entry = F.col("close") * (1 + sign * slippage)
    leave = F.coalesce(F.lead("close").over(w), F.col("__last")) * (1 - sign * slippage)
    return acts.select(*keys, "bar_idx", ((leave - entry) * sign - commission * (entry + leave)).alias("pnl"))


def derived(trades: DataFrame) -> DataFrame:
    """Adds duration_s, bars_in_trade, result, risk_reward."""
    return trades.withColumns(
        {
            "duration_s": F.timestamp_diff("SECOND", F.col("entry_time"), F.col("exit_time")).cast("double"),
            "bars_in_trade": F.col("exit_bar_index") - F.col("entry_bar_index"),
            "result": F.when(F.col("pnl") > 0, "win").when(F.col("pnl") < 0, "loss").otherwise("be"),
            "risk_reward": F.col("pnl") / over_zero(F.col("risk")),
        }
    )


# --- first passages ---------------------------------------------------------------

#: Bars, or nodes of the level below, in a node; levels above the bars.
FAN, LEVELS = 64, 3


def bar_index(rows: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(symbol, level, node, lo, hi, top, bottom, drop, rise): what a run of fan**level bars can set off.

    lo and hi are its extremes, top and bottom those of its closes, ``drop`` the
    most that a low falls below the highest close up to its bar, ``rise`` the
    most that a high stands above the lowest. Each level is made of the one below.
    """
    level = rows.select("symbol", F.col("bar_idx").alias("node"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("close").alias("top"), F.col("close").alias("bottom"), (F.col("close") - F.col("low")).alias("drop"), (F.col("high") - F.col("close")).alias("rise"))
    out = level.withColumn("level", F.lit(0))
    for k in range(1, levels + 1):
        level = level.withColumn("parent", F.expr(f"node div {fan}"))
        before = Window.partitionBy("symbol", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumns({"__top": F.max("top").over(before), "__bottom": F.min("bottom").over(before)})
        level = level.groupBy("symbol", "parent").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top"), F.min("bottom").alias("bottom"),
            F.max(F.greatest("drop", F.col("__top") - F.col("lo"))).alias("drop"), F.max(F.greatest("rise", F.col("hi") - F.col("__bottom"))).alias("rise"),
        ).withColumnRenamed("parent", "node")
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def first_passages(trades: DataFrame, rows: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The first bar after each trade's own on which its stop, trailing stop or target is met.

    ``trades``: symbol, id, bar_idx, dir, stop, take, dist (null: none). The bars
    after an entry are at most fan - 1 nodes a level, then nodes of the highest;
    they meet the index in an equi-join. The first node that can set a trade off
    is opened level by level, so a trade never meets all bars after it. Adds
    exit_bar, reason and raw_exit, null where nothing is met. A trailing stop
    follows the best close of the bars so far, the bar's own included; the stop
    comes before the target.
    """
    index = materialize(bar_index(rows, fan, levels))
    nodes = lambda level, first, last: F.when(first <= last, F.transform(F.sequence(first, last), lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
    ends = rows.groupBy("symbol").agg(F.max("bar_idx").alias("last_bar"))
    begin, parts = F.col("bar_idx") + 1, []
    for k in range(levels):
        after = F.ceil(begin / fan)
        parts.append(nodes(k, begin, F.least(after * fan - 1, F.expr(f"last_bar div {fan**k}"))))
        begin = after
    parts.append(nodes(levels, begin, F.expr(f"last_bar div {fan**levels}")))
    open_ = trades.join(ends, "symbol").withColumns({"look": F.concat(*parts), "m_top": F.lit(None).cast("double"), "m_bottom": F.lit(None).cast("double")}).drop("last_bar")
    long = F.col("dir") > 0
    held = ["symbol", "id", "dir", "stop", "take", "dist"]
    for _ in range(levels + 1):
        probes = open_.select(*held, "m_top", "m_bottom", F.explode("look").alias("at")).select(*held, "m_top", "m_bottom", "at.*")
        met = probes.join(index, ["symbol", "level", "node"]).withColumn("start", F.col("node") * F.pow(F.lit(fan), F.col("level")).cast("long"))
        before = Window.partitionBy("symbol", "id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        met = met.withColumns({"m_top": F.greatest("m_top", F.max("top").over(before)), "m_bottom": F.least("m_bottom", F.min("bottom").over(before))})
        fell, rose = F.greatest("drop", F.col("m_top") - F.col("lo")), F.greatest("rise", F.col("hi") - F.col("m_bottom"))
        stopped = F.when(long, holds(F.col("lo") <= F.col("stop")) | holds(fell >= F.col("dist"))).otherwise(holds(F.col("hi") >= F.col("stop")) | holds(rose >= F.col("dist")))
        taken = holds(F.when(long, F.col("hi") >= F.col("take")).otherwise(F.col("lo") <= F.col("take")))
        first = F.struct("level", "node", "m_top", "m_bottom", "top", stopped.alias("stopped"))
        open_ = met.filter(stopped | taken).groupBy(*held).agg(F.min_by(first, "start").alias("f")).select(*held, "f.*")
        children = F.transform(F.sequence(F.col("node") * fan, F.col("node") * fan + (fan - 1)), lambda n: F.struct((F.col("level") - 1).cast("int").alias("level"), n.alias("node")))
        open_ = open_.withColumn("look", F.when(F.col("level") > 0, children).otherwise(F.array(F.struct(F.col("level").cast("int").alias("level"), F.col("node").alias("node")))))
    trail = F.when(long, F.greatest("m_top", "top") - F.col("dist")).otherwise(F.least("m_bottom", "top") + F.col("dist"))
    stop = F.when(long, F.greatest("stop", trail)).otherwise(F.least("stop", trail))
    found = open_.select("symbol", "id", F.col("node").alias("exit_bar"), F.when(F.col("stopped"), "sl").otherwise("tp").alias("reason"), F.when(F.col("stopped"), stop).otherwise(F.col("take")).alias("raw_exit"))
    return trades.join(found, ["symbol", "id"], "left")


HEDGE_SCHEMA = "symbol string, id long, direction string, entry_bar_index long, entry_price double, size double, exit_bar_index long, exit_price double, exit_reason string, pnl double"


def hedge_ledger(rows: DataFrame, initial: float = 1000.0, risk_percent: float = 0.0, commission: float = 0.0, slippage: float = 0.0, fan: int = FAN) -> DataFrame:
    """Concurrent trades that leave only by stop, target, trailing stop or the end.

    The bars and their index are written once, then read by every probe. Exits are first passages, found by equi-joins with an index of bar blocks.
    Capital at an entry is the initial one and the results of all trades that
    left on or before its bar; it matters with ``risk_percent`` alone, and then
    a symbol's trades (not its bars) pass once in order, with the open ones in a
    heap.
    """
    rows = rows.withColumns({n: _optional(rows, n) for n in ("entry_price", "stop_price", "take_price", "size", "trailing_distance")})
    rows = materialize(rows.select("symbol", "bar_idx", "high", "low", "close", "signal", "entry_price", "stop_price", "take_price", "size", "trailing_distance"))
    sign = F.signum(F.col("signal").cast("double")).cast("int")
    acts = positions(rows.filter("signal <> 0"), "id", ["bar_idx"], bar_block())
    trades = acts.select("symbol", (F.col("id") - 1).alias("id"), "bar_idx", sign.alias("dir"), F.coalesce("entry_price", "close").alias("raw"), F.col("stop_price").alias("stop"), F.col("take_price").alias("take"), F.col("trailing_distance").alias("dist"), F.coalesce("size", F.lit(1.0)).alias("size"))
    ends = rows.groupBy("symbol").agg(F.max("bar_idx").alias("last_bar"), F.max_by("close", "bar_idx").alias("last_close"))
    t = first_passages(trades, rows, fan).join(ends, "symbol")
    entry, leave = F.col("raw") * (1 + F.col("dir") * slippage), F.coalesce("raw_exit", "last_close") * (1 - F.col("dir") * slippage)
    t = t.select(
        "symbol", "id", F.when(F.col("dir") > 0, "long").otherwise("short").alias("direction"), F.col("bar_idx").alias("entry_bar_index"), entry.alias("entry_price"), "size",
        F.coalesce("exit_bar", "last_bar").alias("exit_bar_index"), leave.alias("exit_price"), F.coalesce("reason", F.lit("eod")).alias("exit_reason"),
        ((leave - entry) * F.col("dir") - commission * (entry + leave)).alias("pnl"), F.coalesce(F.abs(F.col("raw") - F.col("stop")), F.lit(0.0)).alias("per_unit"),
    )
    if risk_percent <= 0:
        return t.withColumn("pnl", F.col("pnl") * F.col("size")).drop("per_unit")
    ship(rows.sparkSession)

    def sized(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        capital, left, sizes = initial, [], []
        for bar, size, out, reason, unit, per_unit in pdf[["entry_bar_index", "size", "exit_bar_index", "exit_reason", "pnl", "per_unit"]].itertuples(index=False):
            while left and left[0][0] <= bar:
                capital += heapq.heappop(left)[1]
            sizes.append(capital * risk_percent / 100.0 / per_unit if per_unit > 0 else size)
            if reason != "eod":
                heapq.heappush(left, (out, unit * sizes[-1]))
        return pdf.assign(size=sizes, pnl=pdf["pnl"] * sizes).drop(columns="per_unit")

    return t.groupBy("symbol").applyInPandas(sized, HEDGE_SCHEMA)


LIVE_SCHEMA = "symbol string, event string, datetime timestamp, side string, quantity double, entry_price double, exit_price double, pnl double, reason string, balance double, equity double"


def live_rule_ledger(rows: DataFrame, balance: float = 1000.0, risk_percent: float = 1.0, fee: float = 0.0004, slip: float = 0.0) -> DataFrame:
    """Open and close events by the live rules, a symbol at a time.

    Per bar: stop, then target, then the signal; an opposite signal closes and
    reverses, one in the same direction does nothing. The step function is that
    of the streaming job.
    """
    ship(rows.sparkSession)
    rows = rows.withColumns({n: _optional(rows, n) for n in ("stop_price", "take_price", "bid", "ask")})
    rows = rows.select("symbol", F.col("datetime").cast("timestamp").alias("datetime"), "high", "low", "close", "bid", "ask", "signal", "stop_price", "take_price")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = LedgerState(balance), []
        for bar in pdf.sort_values("datetime").itertuples(index=False):
            state, events = step(state, bar, risk_percent, fee, slip)
            out.extend(events)
        return pd.DataFrame(out, columns=[f.split()[0] for f in LIVE_SCHEMA.split(", ")])

    return rows.groupBy("symbol").applyInPandas(run, LIVE_SCHEMA)
