"""Seeded random-walk bars and a bar-by-bar fold used to check the relational trade outcomes."""

import numpy as np
import pandas as pd

HOUR = 3_600_000


def walk_bars(n=400, seed=3, symbol="A", gaps=True):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = np.concatenate([[100.0], close[:-1]])
    high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.006, n))
    low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.006, n))
    steps = np.where(rng.uniform(size=n) < 0.05, 3, 1) if gaps else np.ones(n, int)
    ms = 1_700_000_000_000 // HOUR * HOUR + np.cumsum(steps) * HOUR
    return pd.DataFrame({"symbol": symbol, "ms": ms, "open": open_, "high": high, "low": low, "close": close,
                         "volume": rng.integers(10, 100, n).astype("int64"), "p_long": rng.uniform(size=n), "p_short": rng.uniform(size=n)})


def atr(df, period=14):
    prev = df["close"].shift()
    tr = pd.concat([df.high - df.low, (df.high - prev).abs(), (df.low - prev).abs()], axis=1).max(axis=1)
    return tr.ewm(alpha=1 / period, adjust=False, min_periods=period).mean()


def fold(df, h, tp_m, sl_m, thr, slip, fee, maker_fee=None, timeout=None, rollover=True, pct=0.1, initial=10_000.0):
    """Plain sequential evaluation of one symbol; returns trades and equity per bar."""
    a = atr(df).to_numpy()
    o, hi, lo, c = (df[x].to_numpy() for x in ("open", "high", "low", "close"))
    p = {1: df.p_long.to_numpy(), -1: df.p_short.to_numpy()}
    cash, pos, pend, trades, curve = initial, None, None, [], []
    for t in range(len(df)):
        if pos and t >= pos["bar"] and t > pos.get("fill_bar", -1):
            s = pos["side"]
            sl = lo[t] <= pos["sl"] if s > 0 else hi[t] >= pos["sl"]
            tp = hi[t] >= pos["tp"] if s > 0 else lo[t] <= pos["tp"]
            why, price = ("sl", pos["sl"]) if sl else ("tp", pos["tp"]) if tp else ("timeout", c[t]) if t >= pos["deadline"] else (None, None)
            if why == "timeout" and rollover and p[s][t] >= thr and a[t] > 0:
                pos.update(tp=c[t] + s * tp_m * a[t], sl=c[t] - s * sl_m * a[t], deadline=t + h)
            elif why:
                limit = timeout is not None and why == "tp"
                px = price if limit else price * (1 - s * slip)
                out_fee = px * pos["qty"] * (maker_fee if limit else fee)
                gain = s * pos["qty"] * (px - pos["entry"])
                cash += pos["margin"] + gain - out_fee
                trades.append((pos["signal"], t, s, why, pos["qty"], pos["entry"], px, gain - pos["fee"] - out_fee))
                pos = None
        if timeout is not None and pend and not pos:
            if t <= pend["expiry"]:
                if (lo[t] <= pend["limit"]) if pend["side"] > 0 else (hi[t] >= pend["limit"]):
                    pos = enter(pend["limit"], pend["side"], t, pend["atr"], cash * pct / pend["limit"], maker_fee, h, tp_m, sl_m, pend["signal"])
                    pos["fill_bar"] = t
                    cash -= pos["margin"] + pos["fee"]
                    pend = None
            else:
                pend = None
        if not pos and not pend and t + 1 < len(df) and a[t] > 0:
            s, best = 0, thr
            if p[1][t] >= thr:
                s, best = 1, p[1][t]
            if p[-1][t] > best:
                s = -1
            if s and timeout is not None:
                pend = dict(side=s, limit=c[t], atr=a[t], expiry=t + timeout, signal=t)
            elif s:
                pos = enter(o[t + 1] * (1 + s * slip), s, t + 1, a[t], cash * pct / o[t + 1], fee, h, tp_m, sl_m, t)
                cash -= pos["margin"] + pos["fee"]
        held = pos["margin"] + pos["side"] * pos["qty"] * (c[t] - pos["entry"]) if pos else 0.0
        curve.append(cash + held)
    return trades, curve


def enter(price, side, bar, a, qty, fee, h, tp_m, sl_m, signal):
    return dict(entry=price, side=side, bar=bar, qty=qty, margin=price * qty, fee=price * qty * fee, signal=signal,
                tp=price + side * tp_m * a, sl=price - side * sl_m * a, deadline=bar + h)
