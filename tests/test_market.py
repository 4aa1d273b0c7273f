"""Golden cases, a bar-loop check of the ledger, and SQL comparison of every market query."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from barline.functions.position import LedgerState, step
from barline.operators import candles as C
from barline.operators import indicators, ledger, patterns, quality, signals
from barline.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "symbol string, datetime timestamp, open double, high double, low double, close double, volume double, signal int, stop_price double, take_price double, trailing_distance double"


def bars(spark, rows, symbol="S"):
    """rows: (open, high, low, close, volume, signal, stop, take, trail)."""
    t0 = datetime(2024, 1, 1)
    data = [(symbol, t0 + timedelta(hours=i), *map(lambda x: None if x is None else float(x), r[:5]), r[5], *r[6:]) for i, r in enumerate(rows)]
    return C.with_bar_idx(spark.createDataFrame(data, SCHEMA))


def test_pairing_golden(spark):
    rows = [(99, 101, 98, 100, 1, 1, None, None, None), (104, 106, 103, 105, 1, 1, None, None, None), (96, 97, 94, 95, 1, 1, None, None, None)]
    r = ledger.pairing_summary(bars(spark, rows)).first()
    assert (r["equity_final"], r["pnl"], r["win_rate"]) == (1005.0, 5.0, 1.0)


def test_empty_and_single_row(spark):
    none = bars(spark, [(1, 1, 1, 1, 1, 0, None, None, None)]).filter("false")
    assert ledger.single_position_ledger(none).count() == 0
    assert quality.report(none, 60).count() == 0
    assert patterns.detect_fvg(none).count() == 0
    one = bars(spark, [(10, 11, 9, 10, 1, 1, None, None, None)])
    t = ledger.single_position_ledger(one).first()
    assert (t["exit_reason"], t["pnl"], t["result"]) == ("eod", 0.0, "be")
    assert indicators.add_supertrend(indicators.add_macd(one)).first()["macd"] == 0.0


def test_nulls_and_constant_series(spark):
    rows = [(10, 10, 10, 10, 0, 0, None, None, None)] * 30 + [(None, None, None, None, None, 0, None, None, None)]
    df = indicators.add_rsi(indicators.add_rsi(bars(spark, rows)), name="filled", fill=50.0)
    last = [r for r in df.orderBy("bar_idx").collect()][20]
    assert last["rsi"] is None and last["filled"] == 50.0
    assert quality.integrity_issues(bars(spark, rows)).count() == 3
    assert {r["vwap"] for r in indicators.add_vwap(bars(spark, rows)).collect()} == {None}


def loop_ledger(rows, initial, risk, comm, slip):
    """The same rules, bar by bar."""
    open_, out, cap = None, [], initial

    def leave(t, px, i, why):
        nonlocal cap
        px *= 1 - t["d"] * slip
        pnl = (px - t["e"]) * t["s"] * t["d"] - comm * t["e"] * t["s"] - comm * px * t["s"]
        cap += pnl
        out.append((t["b"], i, why, pnl, t["mf"], t["ma"]))

    for i, (o, h, l, c, v, sig, sp, tp, tr) in enumerate(rows):
        if open_:
            t = open_
            a, b = ((h - t["e"]) * t["s"], (l - t["e"]) * t["s"]) if t["d"] > 0 else ((t["e"] - l) * t["s"], (t["e"] - h) * t["s"])
            t["mf"], t["ma"] = max(t["mf"], a), min(t["ma"], b)
            if t["tr"] is not None:
                n = c - t["d"] * t["tr"]
                t["sp"] = n if t["sp"] is None else (max if t["d"] > 0 else min)(t["sp"], n)
            sl = t["sp"] is not None and (l <= t["sp"] if t["d"] > 0 else h >= t["sp"])
            tk = t["tp"] is not None and (h >= t["tp"] if t["d"] > 0 else l <= t["tp"])
            if sl or tk:
                leave(t, t["sp"] if sl else t["tp"], i, "sl" if sl else "tp")
                open_ = None
        if sig:
            if open_:
                leave(open_, c, i, "signal")
            d = 1 if sig > 0 else -1
            pur = abs(c - sp) if sp is not None else 0
            size = cap * risk / 100 / pur if risk and pur else 1.0
            open_ = {"b": i, "d": d, "e": c * (1 + d * slip), "s": size, "sp": sp, "tp": tp, "tr": tr, "mf": 0.0, "ma": 0.0}
    if open_:
        leave(open_, rows[-1][3], len(rows) - 1, "eod")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_single_position_matches_bar_loop(spark, seed):
    rnd = random.Random(seed)
    rows, c = [], 100.0
    for _ in range(150):
        o, c = c, max(5.0, c + rnd.uniform(-4, 4))
        h, l = max(o, c) + rnd.random() * 2, min(o, c) - rnd.random() * 2
        s = rnd.choice([0, 0, 0, 1, -1])
        sp = c - s * rnd.uniform(1, 6) if s and rnd.random() < 0.7 else None
        tp = c + s * rnd.uniform(1, 8) if s and rnd.random() < 0.7 else None
        rows.append((o, h, l, c, 1.0, s, sp, tp, rnd.uniform(1, 5) if s and rnd.random() < 0.4 else None))
    for risk in (0.0, 1.0):
        got = ledger.single_position_ledger(bars(spark, rows), 1000.0, risk, 0.001, 0.0005).orderBy("id").collect()
        want = loop_ledger(rows, 1000.0, risk, 0.001, 0.0005)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert (g["entry_bar_index"], g["exit_bar_index"], g["exit_reason"]) == w[:3]
            assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip((g["pnl"], g["max_favor"], g["max_adverse"]), w[3:]))


def test_recurrence_blocks_do_not_matter(spark):
    rnd = random.Random(5)
    rows = [(1, 1, 1, rnd.uniform(1, 9), 1, 0, None, None, None) for _ in range(300)]
    from barline.functions.recurrence import ewm_map, linear_recurrences
    from pyspark.sql import functions as F

    df = bars(spark, rows)
    got = linear_recurrences(df, {"e": ewm_map(F.col("close"), 0.1)}, block_rows=37).orderBy("bar_idx").toPandas()
    assert (got["e"] - got["close"].ewm(alpha=0.1, adjust=False).mean()).abs().max() < 1e-9


def test_collision_and_volume_filter(spark):
    c = QUERIES["fvg_signals"](spark, SF)
    assert c.groupBy("symbol", "bar_idx").count().filter("count > 1").count() == 0


def test_hedge_without_overlap_equals_single(spark):
    rows = [(10, 11, 9, 10, 1, 1, 8.0, 12.0, None), (10, 12.5, 9.5, 12, 1, 0, None, None, None), (12, 13, 11, 12, 1, -1, 14.0, 9.0, None), (12, 15, 11, 14, 1, 0, None, None, None)]
    a = [(r["entry_bar_index"], r["exit_bar_index"], r["exit_reason"], r["pnl"]) for r in ledger.hedge_ledger(bars(spark, rows)).orderBy("id").collect()]
    b = [(r["entry_bar_index"], r["exit_bar_index"], r["exit_reason"], r["pnl"]) for r in ledger.single_position_ledger(bars(spark, rows)).orderBy("id").collect()]
    assert a == b


def loop_hedge(rows, initial, risk, comm, slip):
    """Every trade against every bar after it; capital summed anew at each entry."""
    closed, out = [], []
    for i, (_, _, _, c, _, sig, sp, tp, tr) in enumerate(rows):
        if not sig:
            continue
        best, end = None, (len(rows) - 1, "eod", rows[-1][3])
        for j in range(i + 1, len(rows)):
            _, h, l, cl = rows[j][:4]
            best = cl if best is None else (max if sig > 0 else min)(best, cl)
            stop = sp
            if tr is not None:
                stop = best - sig * tr if sp is None else (max if sig > 0 else min)(sp, best - sig * tr)
            if stop is not None and (l <= stop if sig > 0 else h >= stop):
                end = (j, "sl", stop)
                break
            if tp is not None and (h >= tp if sig > 0 else l <= tp):
                end = (j, "tp", tp)
                break
        capital = initial + sum(p for b, why, p in closed if b <= i and why != "eod")
        size = capital * risk / 100 / abs(c - sp) if risk and sp is not None and c != sp else 1.0
        into, leave = c * (1 + sig * slip), end[2] * (1 - sig * slip)
        pnl = ((leave - into) * sig - comm * (into + leave)) * size
        closed.append((end[0], end[1], pnl))
        out.append((i, end[0], end[1], size, leave, pnl))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hedge_matches_bar_loop(spark, seed):
    """Overlapping trades, trailing stops, and an index of three levels of 4 bars."""
    rnd = random.Random(seed)
    rows, c = [], 100.0
    for _ in range(160):
        o, c = c, max(5.0, c + rnd.uniform(-3, 3))
        h, l = max(o, c) + rnd.random(), min(o, c) - rnd.random()
        s = rnd.choice([0, 1, -1])
        rows.append((o, h, l, c, 1.0, s, c - s * rnd.uniform(1, 25) if s and rnd.random() < 0.7 else None, c + s * rnd.uniform(1, 25) if s and rnd.random() < 0.6 else None, rnd.uniform(2, 25) if s and rnd.random() < 0.4 else None))
    two = bars(spark, rows).unionByName(bars(spark, rows[:7], "T"))
    for risk, fan in ((0.0, 64), (1.0, 4)):
        got = ledger.hedge_ledger(two, 1000.0, risk, 0.001, 0.0005, fan).orderBy("symbol", "id").collect()
        for symbol, given in (("S", rows), ("T", rows[:7])):
            want, mine = loop_hedge(given, 1000.0, risk, 0.001, 0.0005), [r for r in got if r["symbol"] == symbol]
            assert [(r["entry_bar_index"], r["exit_bar_index"], r["exit_reason"]) for r in mine] == [w[:3] for w in want]
            assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for r, w in zip(mine, want) for a, b in zip((r["size"], r["exit_price"], r["pnl"]), w[3:]))


def test_reversals_equal_the_ledger(spark):
    from barline.plans import tables

    rows = signals.ema_cross_signals(tables.candles(spark, SF))
    got = {(r["symbol"], r["bar_idx"]): r["pnl"] for r in ledger.reversal_pnl(rows, 0.001, 0.0005).collect()}
    want = {(r["symbol"], r["entry_bar_index"]): r["pnl"] for r in ledger.single_position_ledger(rows, commission=0.001, slippage=0.0005).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)


def test_live_step_reverses_and_stops():
    class Bar:
        symbol, datetime, bid, ask, volume = "S", datetime(2024, 1, 1), None, None, 1.0

        def __init__(self, h, l, c, s=0, sp=None, tp=None):
            self.high, self.low, self.close, self.signal, self.stop_price, self.take_price = h, l, c, s, sp, tp

    state, e = step(LedgerState(1000.0), Bar(11, 9, 10, 1, 8.0, 20.0), 1.0, 0.0, 0.0)
    assert e[0][1] == "open" and state.side == 1
    same, e = step(state, Bar(11, 9, 10, 1), 1.0, 0.0, 0.0)
    assert e == [] and same == state
    turned, e = step(state, Bar(11, 9, 10, -1), 1.0, 0.0, 0.0)
    assert [x[1] for x in e] == ["close", "open"] and turned.side == -1
    stopped, e = step(state, Bar(11, 7, 10), 1.0, 0.0, 0.0)
    assert e[0][8] == "sl" and stopped.side == 0 and math.isclose(e[0][7], (8.0 - 10.0) * state.quantity)


def test_strategy_contract(spark):
    df = bars(spark, [(1, 1, 1, 1, 1, 0, None, None, None)])
    assert signals.run_strategy(df, lambda x: x).count() == 1
    with pytest.raises(ValueError):
        signals.run_strategy(df, lambda x: x.filter("false"))
    with pytest.raises(ValueError):
        signals.run_strategy(df, lambda x: x.drop("signal"))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    cells = {c: df[c].map(lambda x: "-" if pd.isna(x) else f"{round(x, 5) + 0.0:.5f}" if isinstance(x, float) else str(x)) for c in sorted(df.columns)}
    out = pd.DataFrame(cells)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sql, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql.sql(SQL[name]).df()
    for c in want.columns:  # the same kinds of cells on both sides
        if c in got and want[c].dtype.kind in "fiu" and got[c].dtype.kind in "fiuO":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
        elif str(want[c].dtype).startswith(("Int", "datetime")):
            want[c] = want[c].astype(float if str(want[c].dtype).startswith("Int") else str)
            got[c] = got[c].astype(float if str(got[c].dtype)[0] in "fi" else str)
    pd.testing.assert_frame_equal(plain(got), plain(want))


def test_books_of_one_instant_equal_sql(spark, tmp_path):
    """Two ticks of a symbol at one instant, one of them twice, and a price of zero whose levels tie."""
    con = duckdb.connect()
    rows = "(1, TIMESTAMP '2024-01-01', 'a', 10.0, 5), (2, TIMESTAMP '2024-01-01', 'a', 11.0, 7), (3, TIMESTAMP '2024-01-01', 'a', 11.0, 7), (4, TIMESTAMP '2024-01-02', 'a', 0.0, 9), (5, TIMESTAMP '2024-01-01', 'b', 3.0, 2)"
    con.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, 1::BIGINT AS user_id, event_type, value::DOUBLE AS value, '{{\"k\": ' || k || '}}' AS props FROM (VALUES {rows}) e(event_id, ts, event_type, value, k)) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = QUERIES["book_depth"](spark, str(tmp_path)).toPandas(), con.sql(SQL["book_depth"]).df()
    assert len(got) == 30
    for c in ("level", "snapshot_ts"):
        got[c], want[c] = got[c].astype(str), want[c].astype(str)
    pd.testing.assert_frame_equal(plain(got), plain(want))
