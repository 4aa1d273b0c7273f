"""The position rule of one bar, shared by the batch ledger and the stream."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class LedgerState:
    balance: float
    side: int = 0
    quantity: float = 0.0
    entry: float = 0.0
    stop: float | None = None
    take: float | None = None


def _known(x) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


def step(state: LedgerState, bar, risk_percent: float, fee: float, slip: float) -> tuple[LedgerState, list[tuple]]:
    """(state, bar with its signal) -> (state, event rows).

    Stop before target before signal; fills at a stop or target take that price
    as bid and ask. A sell hits the bid, a buy lifts the ask; without quotes the
    close stands for both.
    """
    events: list[tuple] = []

    def fill(side: int, price: float | None) -> float:
        if side > 0:
            quote = price if price is not None else _known(bar.ask) or bar.close
            return quote * (1 + slip) * (1 + fee)
        quote = price if price is not None else _known(bar.bid) or bar.close
        return quote * (1 - slip) * (1 - fee)

    def row(event, s, exit_price, pnl, reason, balance, equity):
        return (bar.symbol, event, bar.datetime, "long" if s.side > 0 else "short", s.quantity, s.entry, exit_price, pnl, reason, balance, equity)

    def close(s: LedgerState, price: float | None, reason: str) -> LedgerState:
        px = fill(-s.side, price)
        pnl = (px - s.entry) * s.quantity * s.side
        after = LedgerState(s.balance + pnl)
        events.append(row("close", s, px, pnl, reason, after.balance, after.balance))
        return after

    if state.side:
        adverse, favorable = (bar.low, bar.high) if state.side > 0 else (bar.high, bar.low)
        if state.stop is not None and state.side * adverse <= state.side * state.stop:
            state = close(state, state.stop, "sl")
        elif state.take is not None and state.side * favorable >= state.side * state.take:
            state = close(state, state.take, "tp")
    if bar.signal and bar.signal * state.side <= 0:
        if state.side:
            state = close(state, None, "reversal")
        side = 1 if bar.signal > 0 else -1
        px = fill(side, None)
        quantity = state.balance * risk_percent / 100.0 / px if px else 0.0
        if quantity > 0:
            state = replace(state, side=side, quantity=quantity, entry=px, stop=_known(bar.stop_price), take=_known(bar.take_price))
            events.append(row("open", state, None, None, None, state.balance, state.balance + (bar.close - px) * quantity * side))
    return state, events
