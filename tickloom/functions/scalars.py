"""Scalar column expressions shared by evaluation, studies and streaming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """One cost model for every operator."""

    taker_fee: float = 0.001
    maker_fee: float = 0.001
    slippage: float = 0.0002


def _c(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero or either side is missing."""
    return F.try_divide(_c(a), F.nullif(_c(b), F.lit(0.0)))


# --- fills -------------------------------------------------------------------------------------

def taker_price(price: Column | str, is_buy: Column, slippage: Column | float) -> Column:
    """Market order: pays the slippage in the direction of the trade."""
    slip = _c(slippage)
    return F.when(is_buy, _c(price) * (1 + slip)).otherwise(_c(price) * (1 - slip))


def fill(price: Column, qty: Column | str, fee_rate: Column | float) -> Column:
    """struct(price, qty, notional, fee) of an executed order."""
    notional = price * _c(qty)
    return F.struct(
        price.alias("price"), _c(qty).alias("qty"), notional.alias("notional"), (notional * _c(fee_rate)).alias("fee")
    )


def taker_fill(price: Column | str, qty: Column | str, is_buy: Column, costs: Costs) -> Column:
    return fill(taker_price(price, is_buy, costs.slippage), qty, costs.taker_fee)


def maker_fill(price: Column | str, qty: Column | str, costs: Costs) -> Column:
    """Resting limit order: executes at its own price for the maker fee."""
    return fill(_c(price), qty, costs.maker_fee)


def limit_touched(side: Column | str, low: Column | str, high: Column | str, limit: Column | str) -> Column:
    return F.when(_c(side) > 0, _c(low) <= _c(limit)).otherwise(_c(high) >= _c(limit))


def tp_touched(side: Column | str, low: Column, high: Column, tp: Column) -> Column:
    return F.when(_c(side) > 0, high >= tp).otherwise(low <= tp)


def sl_touched(side: Column | str, low: Column, high: Column, sl: Column) -> Column:
    return F.when(_c(side) > 0, low <= sl).otherwise(high >= sl)


def bracket_exit(side: Column | str, low: Column, high: Column, tp: Column, sl: Column) -> Column:
    """'sl', 'tp' or NULL for one bar; a bar touching both counts as the stop."""
    return F.when(sl_touched(side, low, high, sl), F.lit("sl")).when(tp_touched(side, low, high, tp), F.lit("tp"))


def round_trip_cost_pct(costs: Costs, maker: bool = False) -> float:
    return 2.0 * (costs.maker_fee if maker else costs.taker_fee + costs.slippage) * 100.0


# --- study scalars -----------------------------------------------------------------------------

def regime(change_pct: Column | str, band: float = 5.0) -> Column:
    x = _c(change_pct)
    return F.when(x > band, "up").when(x < -band, "down").when(x.isNotNull(), "flat")


def expected_value(p: Column | str, r: Column | str, sl_pct: Column | str, cost: float) -> Column:
    """Expected result of a bracket trade in units of its risk, after costs."""
    return _c(p) * _c(r) - (1 - _c(p)) - F.lit(cost) / F.greatest(_c(sl_pct), F.lit(1e-9))


def break_even_pct(tp: Column | float, sl: Column | float) -> Column:
    return _c(sl) / (_c(tp) + _c(sl)) * 100.0


# Correlation limits of the diversification verdict.
MAX_MEAN_CORR = 0.40
MAX_PEAK_CORR = 0.60
DECAY_CORR = -0.30


def diversification_verdict(mean_corr: Column | str, peak_corr: Column | str, cagr_pct: Column | str) -> Column:
    mean, peak, cagr = _c(mean_corr), _c(peak_corr), _c(cagr_pct)
    return (
        F.when((cagr <= 0) & (mean <= DECAY_CORR), "trap")
        .when(cagr <= 0, "losing")
        .when(mean > MAX_MEAN_CORR, "correlated")
        .when(peak > MAX_PEAK_CORR, "unstable")
        .otherwise("candidate")
    )


def clamp_atr(distance: Column, atr: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(distance, atr * lo), atr * hi)


def position_notional(cash: Column, sl_pct: Column, fraction: float, risk_pct: float | None = None) -> Column:
    """Fixed fraction of cash, or the size whose stop costs ``risk_pct`` of cash (95 % ceiling)."""
    if risk_pct is None:
        return cash * fraction
    return F.least(cash * risk_pct / F.greatest(sl_pct, F.lit(1e-9)), cash * 0.95)


def open_pnl(side: Column | str, qty: Column | str, entry: Column | str, last: Column | str) -> Column:
    """struct(pnl, pct) of an open position."""
    move = _c(side) * (_c(last) - _c(entry))
    return F.struct((move * _c(qty)).alias("pnl"), (ratio(move, entry) * 100.0).alias("pct"))


def drift_flag(weight: Column | str, target: Column | str, limit_pp: float = 3.0) -> Column:
    gap = (_c(weight) - _c(target)) * 100.0
    return F.when(gap >= limit_pp, "over").when(gap <= -limit_pp, "under").otherwise("on_target")


# --- names and clocks --------------------------------------------------------------------------

def perpetual_symbol(symbol: Column | str) -> Column:
    """BASE/QUOTE -> BASE/QUOTE:QUOTE; already-settled names stay."""
    s = _c(symbol)
    return F.when(s.contains(":"), s).otherwise(F.concat(s, F.lit(":"), F.split_part(s, F.lit("/"), F.lit(2))))


def path_safe(symbol: Column | str) -> Column:
    return F.translate(_c(symbol), "/:", "-_")


def local_clock(ts_utc: Column | str, zone: str) -> Column:
    return F.from_utc_timestamp(_c(ts_utc), zone)


def hour_angle(ts: Column | str) -> Column:
    return (F.hour(_c(ts)) + F.minute(_c(ts)) / F.lit(60.0)) * (2.0 * 3.141592653589793) / F.lit(24.0)


def candle_parts(ts: Column | str) -> list[Column]:
    """Clock position and shape of a bar."""
    angle, span = hour_angle(ts), F.col("high") - F.col("low")
    return [
        F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"), F.weekday(_c(ts)).cast("double").alias("dow"),
        ratio(span, "close").alias("range_norm"), ratio(F.col("close") - F.col("open"), span).alias("body_ratio"),
    ]


def alert_category(kind: Column | str, pnl: Column | str, ok: Column | str) -> Column:
    """Timeline category of an alert row; an outage row without ``ok`` is an outage."""
    k = _c(kind)
    return (
        F.when(k == "trade_open", "open")
        .when((k == "trade_close") & (_c(pnl) >= 0), "close_gain")
        .when((k == "trade_close") & (_c(pnl) < 0), "close_loss")
        .when(k == "trade_rollover", "rollover")
        .when((k == "connection") & F.coalesce(_c(ok), F.lit(False)), "recovery")
        .when(k == "connection", "outage")
        .otherwise("other")
    )
