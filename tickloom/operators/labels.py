"""Forward scans: which barrier is reached first, labels and the structure barriers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import clamp_atr, expected_value, ratio
from tickloom.operators.chunking import CHUNK, ORD, drop_halo, with_halo
from tickloom.operators.rolling import rolling


@dataclass(frozen=True)
class Geometry:
    """Barrier distances in ATR and the holding limit in bars."""

    tp_mult: float = 1.5
    sl_mult: float = 2.0
    horizon: int = 24


class ForwardScan:
    """The next ``horizon`` bars of every row as lead columns of one window.

    Leads are constant-time per row and the touch tests compile to straight-line code, so the
    scan never joins the table with itself and never builds per-row arrays of structs.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], horizon: int, arrays: dict[str, str] | None = None):
        self.horizon = horizon
        self.columns = [f"_{c}{k}" for k in range(1, horizon + 1) for c in ("high", "low")]
        over = f"OVER (PARTITION BY {', '.join([*keys, CHUNK])} ORDER BY {ORD})"
        leads = [f"lead({c}, {k}) {over} AS _{c}{k}" for k in range(1, horizon + 1) for c in ("high", "low")]
        for name, column in (arrays or {}).items():
            leads.append(f"array({', '.join(f'lead({column}, {k}) {over}' for k in range(1, horizon + 1))}) AS {name}")
        # one SQL text per column: building the same expressions call by call costs seconds of driver time
        self.df = df.selectExpr("*", *leads)

    def first(self, condition: str, after: str | None = None, limit: int | None = None) -> Column:
        """Smallest step k whose bar satisfies the SQL ``condition`` on {low}/{high}, later than ``after``."""
        late = f" AND {after} < {{k}}" if after else ""
        steps = [
            f"CASE WHEN ({condition}){late} THEN {{k}} END".format(low=f"_low{k}", high=f"_high{k}", k=k)
            for k in range(1, (limit or self.horizon) + 1)
        ]
        return F.expr(f"coalesce({', '.join([*steps, 'null'])})")

    def first_tp(self, side: str | int, tp: str, after: str | None = None, limit: int | None = None) -> Column:
        return self.first(self._by_side(side, f"{{high}} >= {tp}", f"{{low}} <= {tp}"), after, limit)

    def first_sl(self, side: str | int, sl: str, after: str | None = None, limit: int | None = None) -> Column:
        return self.first(self._by_side(side, f"{{low}} <= {sl}", f"{{high}} >= {sl}"), after, limit)

    @staticmethod
    def _by_side(side: str | int, long: str, short: str) -> str:
        if isinstance(side, int):
            return long if side > 0 else short
        return f"({side} > 0 AND {long}) OR ({side} < 0 AND {short})"

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.columns)


def _label_columns(first_tp: Column, first_sl: Column, valid: Column) -> dict[str, Column]:
    won = first_tp.isNotNull() & (first_sl.isNull() | (first_tp < first_sl))
    return {
        "label": F.when(valid, F.when(won, 1).otherwise(0)),
        "hit_step": F.when(won, first_tp - 1).otherwise(first_sl - 1),
    }


def barrier_labels(
    df: DataFrame, horizon: int, direction: str, tp: str, sl: str, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Label rows carrying explicit barrier prices: 1 iff the target is touched before the stop.

    Bars t+1..t+H are scanned; a bar touching both counts as the stop. The last H+1 rows of a key
    have no label; ``hit_step`` is zero-based.
    """
    side = 1 if direction == "long" else -1
    rows, w = with_halo(df, keys, back=0, ahead=horizon + 1)
    scan = ForwardScan(rows, keys, horizon)
    out = scan.df.withColumns({
        "_tp_at": scan.first_tp(side, tp),
        "_sl_at": scan.first_sl(side, sl),
        "_full": F.lead("i", horizon + 1).over(w).isNotNull(),
    })
    valid = F.col("_full") & F.col(tp).isNotNull() & F.col(sl).isNotNull()
    out = out.withColumns(_label_columns(F.col("_tp_at"), F.col("_sl_at"), valid))
    return drop_halo(scan.done(out)).drop("_tp_at", "_sl_at", "_full")


def triple_barrier_labels(
    df: DataFrame, geometry: Geometry, direction: str, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """ATR barriers around the next bar's open (input: bars with ``i`` and ``atr``)."""
    s = 1 if direction == "long" else -1
    rows, w = with_halo(df, keys, back=0, ahead=1)
    rows = drop_halo(rows.withColumn("entry", F.lead("open").over(w)))
    usable = F.col("atr") > 0
    rows = rows.withColumns({
        "tp": F.col("entry") + s * geometry.tp_mult * F.col("atr"),
        "sl": F.col("entry") - s * geometry.sl_mult * F.col("atr"),
    })
    out = barrier_labels(rows, geometry.horizon, direction, "tp", "sl", keys)
    return out.withColumn("label", F.when(usable, F.col("label")))


def structure_barriers(
    df: DataFrame, swing: int = 12, level: int = 60, sl_band: tuple[float, float] = (0.5, 4.0),
    tp_band: tuple[float, float] = (0.5, 8.0), fallback: float = 2.0, keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Targets at the recent range, stops behind the last swing, both clamped in ATR units."""
    rows, w = with_halo(df, keys, back=max(swing, level), ahead=1)
    rows = drop_halo(rows.withColumns({
        "entry": F.lead("open").over(w),
        "_sw_lo": rolling(w, swing, "min", "low"),
        "_sw_hi": rolling(w, swing, "max", "high"),
        "_lv_hi": rolling(w, level, "max", "high"),
        "_lv_lo": rolling(w, level, "min", "low"),
    }))
    entry, atr = F.col("entry"), F.col("atr")

    def known(distance: Column) -> Column:
        # least/greatest skip NULLs, an unknown distance must stay unknown
        return F.when(distance.isNotNull() & atr.isNotNull(), distance)

    def stop(distance: Column) -> Column:
        return F.when(known(distance).isNotNull(), clamp_atr(distance, atr, *sl_band))

    def target(distance: Column) -> Column:
        far = F.when(distance <= atr * 0.5, atr * fallback).otherwise(distance)
        return F.when(known(distance).isNotNull(), clamp_atr(far, atr, *tp_band))

    rows = rows.withColumns({
        "_l_sl": stop(entry - F.col("_sw_lo")), "_l_tp": target(F.col("_lv_hi") - entry),
        "_s_sl": stop(F.col("_sw_hi") - entry), "_s_tp": target(entry - F.col("_lv_lo")),
    })
    return rows.withColumns({
        "long_tp": entry + F.col("_l_tp"), "long_sl": entry - F.col("_l_sl"),
        "long_r": ratio("_l_tp", "_l_sl"), "long_sl_pct": ratio("_l_sl", entry),
        "short_tp": entry - F.col("_s_tp"), "short_sl": entry + F.col("_s_sl"),
        "short_r": ratio("_s_tp", "_s_sl"), "short_sl_pct": ratio("_s_sl", entry),
    }).drop("_sw_lo", "_sw_hi", "_lv_hi", "_lv_lo", "_l_sl", "_l_tp", "_s_sl", "_s_tp")


def stronger_side(p_long: Column | str, p_short: Column | str | None, threshold: Column | float) -> Column:
    """struct(side, p): long when it clears the threshold, short only when strictly stronger."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pl = F.col(p_long) if isinstance(p_long, str) else p_long
    long_ok = F.coalesce(pl >= thr, F.lit(False))
    if p_short is None:
        short_ok, ps = F.lit(False), F.lit(None).cast("double")
    else:
        ps = F.col(p_short) if isinstance(p_short, str) else p_short
        best = F.when(long_ok, pl).otherwise(thr)
        short_ok = F.coalesce(ps > best, F.lit(False))
    side = F.when(short_ok, -1).when(long_ok, 1).otherwise(0)
    return F.struct(side.alias("side"), F.when(short_ok, ps).when(long_ok, pl).alias("p"))


def best_expected_side(
    threshold: float, min_r: float, min_ev: float | None, cost: float, allow_short: bool = True
) -> Column:
    """struct(side, p, r, ev, sl_pct) of the better admissible side, NULL when none qualifies.

    Reads p_long/p_short and the structure-barrier columns; ties keep the long side.
    """
    def option(prefix: str, side: int) -> Column:
        p, r, sl = F.col(f"p_{prefix}"), F.col(f"{prefix}_r"), F.col(f"{prefix}_sl_pct")
        ev = expected_value(p, r, sl, cost)
        ok = (p >= threshold) & (r >= min_r)
        if min_ev is not None:
            ok = ok & (ev >= min_ev)
        score = ev if min_ev is not None else p
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(
            score.alias("score"), F.lit(side).alias("side"), p.alias("p"), r.alias("r"),
            ev.alias("ev"), sl.alias("sl_pct"),
        ))

    long, short = option("long", 1), option("short", -1)
    # structs order by (score, side): the higher score, on a tie the long side; NULLs are skipped
    return F.greatest(long, short) if allow_short else long


def no_entry_reason(
    in_position: Column, ordinal: Column, warmup: int, features_ok: Column, atr: Column, p: Column,
    threshold: float, blocked: Column,
) -> Column:
    """First reason a bar opens nothing; the model is asked before the position cap is."""
    return (
        F.when(in_position, "in_position")
        .when(ordinal < warmup, "warmup")
        .when(~features_ok, "features_nan")
        .when(atr.isNull() | (atr <= 0), "no_atr")
        .when(p.isNull() | (p < threshold), "below_threshold")
        .when(blocked, "risk_blocked")
        .otherwise("entered")
    )
