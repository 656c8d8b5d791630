"""Stateful per-key position tracker, recent-bar buffer and alert state on streams.

The state of a key is a handful of numbers (or a bounded ring of bars); keys never interact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "variant string, symbol string, ts timestamp, event string, side int, price double"
POSITION = "last_ms long, seen long, side int, entry double, tp double, sl double, deadline long"


def step_position(pos: dict, bar, tp_mult: float, sl_mult: float, horizon: int, threshold: float, rollover: bool) -> list[tuple]:
    """Advance one key by one closed bar; returns (event, side, price) rows and mutates ``pos``."""
    out, side = [], pos["side"]
    n = pos["seen"]
    if side:
        hit_sl = bar.low <= pos["sl"] if side > 0 else bar.high >= pos["sl"]
        hit_tp = bar.high >= pos["tp"] if side > 0 else bar.low <= pos["tp"]
        p = bar.p_long if side > 0 else bar.p_short
        if hit_sl:
            out.append(("sl", side, pos["sl"]))
        elif hit_tp:
            out.append(("tp", side, pos["tp"]))
        elif n >= pos["deadline"]:
            if rollover and p >= threshold and bar.atr > 0:
                pos.update(tp=bar.close + side * tp_mult * bar.atr, sl=bar.close - side * sl_mult * bar.atr, deadline=n + horizon)
                out.append(("roll", side, bar.close))
            else:
                out.append(("timeout", side, bar.close))
        if out and out[-1][0] != "roll":
            pos["side"] = 0
    if not pos["side"] and bar.atr > 0:
        wanted = 1 if bar.p_long >= threshold else 0
        if bar.p_short > (bar.p_long if wanted else threshold):
            wanted = -1
        if wanted:
            pos.update(side=wanted, entry=bar.close, tp=bar.close + wanted * tp_mult * bar.atr,
                       sl=bar.close - wanted * sl_mult * bar.atr, deadline=n + horizon)
            out.append(("open", wanted, bar.close))
    pos["seen"] = n + 1
    return out


def track_positions(bars: DataFrame, horizon: int = 12, tp_mult: float = 1.5, sl_mult: float = 2.0, rollover: bool = True) -> DataFrame:
    """Open/close/roll events per (variant, symbol) with the live convention: fill at the signal
    close, hold ``horizon`` bars. Input: variant, threshold, symbol, ts, ohlc, atr, p_long, p_short."""
    names = ["last_ms", "seen", "side", "entry", "tp", "sl", "deadline"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos = dict(zip(names, state.get)) if state.exists else dict(zip(names, (-1, 0, 0, 0.0, 0.0, 0.0, 0)))
        rows = []
        for bar in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
            ms = int(bar.ts.value // 1_000_000)
            if ms <= pos["last_ms"]:
                continue  # late or repeated
            pos["last_ms"] = ms
            rows += [(*key, bar.ts, *e) for e in step_position(pos, bar, tp_mult, sl_mult, horizon, bar.threshold, rollover)]
        state.update(tuple(pos[n] for n in names))
        yield pd.DataFrame(rows, columns=["variant", "symbol", "ts", "event", "side", "price"])

    return bars.groupBy("variant", "symbol").applyInPandasWithState(run, EVENTS, POSITION, "append", GroupStateTimeout.NoTimeout)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one trigger by time; the source's limit on files per trigger bounds them."""
    return pd.concat(list(batches)).sort_values("ts", kind="stable")


def recent_bars(bars: DataFrame, keep: int) -> DataFrame:
    """After each batch, how many of the last ``keep`` bars a symbol holds, their range and mean close."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, closes = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        rows = _in_order(batches)
        ms = rows["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
        new = ms > (held[-1] if held.size else np.iinfo(np.int64).min)
        ms, first = np.unique(ms[new], return_index=True)
        times = np.concatenate([held, ms])[-keep:]
        closes = np.concatenate([closes, rows["close"].to_numpy(float)[new][first]])[-keep:]
        state.update((times.tolist(), closes.tolist()))
        yield pd.DataFrame({"symbol": [key[0]], "bars": [times.size], "first_ms": [times[0]], "last_ms": [times[-1]], "mean_close": [closes.mean()]})

    return bars.groupBy("symbol").applyInPandasWithState(
        run, "symbol string, bars long, first_ms long, last_ms long, mean_close double", "times array<long>, closes array<double>",
        "update", GroupStateTimeout.NoTimeout)


def drawdown_alarms(equity: DataFrame, threshold: float) -> DataFrame:
    """Drawdown alerts with re-arming at half the threshold; state = (peak, alarmed)."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, alarmed = state.get if state.exists else (0.0, False)
        rows = _in_order(batches)
        value = rows["equity"].to_numpy(float)
        peaks = np.maximum.accumulate(np.append(peak, value))[1:]
        dd = np.where(peaks > 0, value / np.where(peaks > 0, peaks, 1.0) - 1.0, 0.0)
        # 1 sets the alarm, 0 re-arms it, anything between leaves it as it was
        level = np.where(dd <= -threshold, 1, np.where(dd > -threshold / 2.0, 0, -1))
        last = np.maximum.accumulate(np.where(level >= 0, np.arange(level.size), -1))
        on = np.where(last >= 0, level[last], int(alarmed)) == 1
        fresh = on & ~np.append(alarmed, on[:-1]).astype(bool)
        state.update((float(peaks[-1]), bool(on[-1])))
        yield pd.DataFrame({"book": key[0], "ts": rows["ts"].to_numpy()[fresh], "drawdown": dd[fresh]})

    return equity.groupBy("book").applyInPandasWithState(
        run, "book string, ts timestamp, drawdown double", "peak double, alarmed boolean", "append", GroupStateTimeout.NoTimeout)


def daily_loss_alarms(trades: DataFrame, limit: float, start_equity: float) -> DataFrame:
    """One alert per book and UTC day, at the trade whose realised PnL of the day first reaches the limit.

    The limit is a share of the equity at the day's start: ``start_equity`` plus all PnL of earlier days. Batches must
    come in the order of time; within one, rows are put in order. State = (day, PnL before it, PnL of it, alerted).
    """
    day_ms = 86_400_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, before, realised, alerted = state.get if state.exists else (-1, 0.0, 0.0, False)
        rows, out = _in_order(batches), []
        days = rows["ts"].astype("datetime64[ms]").astype("int64").to_numpy() // day_ms
        pnl, ts = rows["pnl"].to_numpy(float), rows["ts"].to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, days[1:] != days[:-1])), days.size)
        for lo, hi in zip(cuts, cuts[1:]):  # one turn per day in the batch
            if days[lo] != day:
                day, before, realised, alerted = int(days[lo]), before + realised, 0.0, False
            sums = realised + np.cumsum(pnl[lo:hi])
            hit = np.flatnonzero(sums <= -limit * (start_equity + before))
            if hit.size and not alerted:
                out.append((key[0], ts[lo + hit[0]], float(sums[hit[0]])))
                alerted = True
            realised = float(sums[-1])
        state.update((day, before, realised, alerted))
        yield pd.DataFrame(out, columns=["book", "ts", "realised"])

    return trades.groupBy("book").applyInPandasWithState(
        run, "book string, ts timestamp, realised double", "day long, before double, realised double, alerted boolean", "append", GroupStateTimeout.NoTimeout)
