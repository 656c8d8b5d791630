"""The per-bar feature table and its parts, computed in one chunked pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import hour_angle, ratio
from tickloom.functions.timeframes import step_ms, to_ts
from tickloom.operators.asof import asof_backward
from tickloom.operators.chunking import CHUNK, deal, drop_halo, number_by_range, number_on_grid, with_halo
from tickloom.operators.rolling import Ewm, add_ewm, log_return, rolling, rolling_z, rsi, span_alpha, true_range

RETURN_LAGS = (1, 3, 5, 15, 30, 60)

# The feature names a model bundle stores.
FEATURE_COLUMNS = [
    "ret_1", "ret_3", "ret_5", "ret_15", "ret_30", "ret_60",
    "vol_15", "vol_60", "vol_ratio",
    "rsi_14", "atr_norm",
    "ema_9_21", "close_ema50",
    "volume_z",
    "range_norm", "range_norm_15", "body_ratio",
    "hour_sin", "hour_cos", "dow",
    "trend_42", "trend_180", "mom_42", "mom_180", "vol_regime", "dd_180",
]
RATE_FEATURE_COLUMNS = ["funding_now", "funding_mean9", "funding_z", "funding_cum9"]


def active_features(with_rates: bool = False) -> list[str]:
    return FEATURE_COLUMNS + (RATE_FEATURE_COLUMNS if with_rates else [])


def atr_spec(period: int = 14) -> dict[str, Ewm]:
    return {"atr": Ewm("_tr", 1.0 / period, min_periods=period)}


def rsi_specs(period: int = 14) -> dict[str, Ewm]:
    return {
        "_gain": Ewm("_up", 1.0 / period, first=1, min_periods=period),
        "_loss": Ewm("_down", 1.0 / period, first=1, min_periods=period),
    }


def ema_specs(spans: Sequence[int] = (9, 21, 50)) -> dict[str, Ewm]:
    return {f"ema{s}": Ewm("close", span_alpha(s)) for s in spans}


def _dealt_bars(bars: DataFrame, timeframe: str, keys: Sequence[str], back: int) -> tuple[DataFrame, WindowSpec, list[str]]:
    """Numbered bars with their halo, dealt by (keys, chunk); the window over them and the columns they had before."""
    numbered = number_on_grid(bars, keys, step_ms(timeframe))
    rows, w = with_halo(numbered, keys, back=back)
    return deal(rows, [*keys, CHUNK]), w, numbered.columns


def with_indicators(
    bars: DataFrame, timeframe: str, atr_period: int = 14, keys: Sequence[str] = ("symbol",),
    ema: bool = False, rsi_period: int | None = None,
) -> DataFrame:
    """Bars plus ordinal ``i`` and ``atr`` (optionally ema9/21/50 and ``rsi``)."""
    specs = atr_spec(atr_period)
    if ema:
        specs |= ema_specs()
    if rsi_period:
        specs |= rsi_specs(rsi_period)
    rows, w, read = _dealt_bars(bars, timeframe, keys, back=1)
    rows = rows.withColumn("_tr", true_range(w))
    if rsi_period:
        rows = rows.withColumn("_diff", F.col("close") - F.lag("close").over(w))
        rows = rows.withColumn("_up", F.greatest("_diff", F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_diff"), F.lit(0.0)))
        rows = rows.withColumns({c: F.when(F.col("_diff").isNotNull(), F.col(c)) for c in ("_up", "_down")})
    rows = add_ewm(rows, keys, specs, read)
    if rsi_period:
        rows = rows.withColumn("rsi", rsi("_gain", "_loss")).drop("_gain", "_loss", "_diff", "_up", "_down")
    return rows.drop("_tr")


def compute_features(
    bars: DataFrame, timeframe: str, atr_period: int = 14, keys: Sequence[str] = ("symbol",),
    rates: DataFrame | None = None,
) -> DataFrame:
    """26 features per bar (30 with ``rates``) plus ``atr``; a value at a bar never reads later bars.

    Every window shares (key, chunk) partitioning, so one shuffle feeds all rolling frames, lags and exponential means;
    the halo is that of the longest bounded frame.
    """
    specs = atr_spec(atr_period) | rsi_specs(14) | ema_specs()
    # Two stacked look-backs at most: a one-bar difference under the 180-bar frame.
    rows, w, read = _dealt_bars(bars, timeframe, keys, back=181)
    rows = rows.withColumns({f"ret_{k}": log_return(w, k) for k in RETURN_LAGS})
    diff = F.col("close") - F.lag("close").over(w)
    span = F.col("high") - F.col("low")
    rows = rows.withColumns({
        "_tr": true_range(w),
        "_up": F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))),
        "_down": F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))),
        "mom_42": log_return(w, 42),
        "mom_180": log_return(w, 180),
        "range_norm": ratio(span, "close"),
        "body_ratio": ratio(F.col("close") - F.col("open"), span),
    })
    rows = rows.withColumns({
        "vol_15": rolling(w, 15, "std", "ret_1"),
        "vol_60": rolling(w, 60, "std", "ret_1"),
        "_vol_42": rolling(w, 42, "std", "ret_1"),
        "_vol_180": rolling(w, 180, "std", "ret_1"),
        "volume_z": rolling_z(w, 60, "volume"),
        "range_norm_15": rolling(w, 15, "mean", "range_norm"),
        "trend_42": ratio("close", rolling(w, 42, "mean", "close")) - 1.0,
        "trend_180": ratio("close", rolling(w, 180, "mean", "close")) - 1.0,
        "dd_180": ratio("close", rolling(w, 180, "max", "close")) - 1.0,
    })
    rows = add_ewm(rows, keys, specs, read)
    angle = hour_angle(to_ts("ms"))
    rows = rows.withColumns({
        "vol_ratio": ratio("vol_15", "vol_60"),
        "vol_regime": ratio("_vol_42", "_vol_180"),
        "rsi_14": rsi("_gain", "_loss"),
        "atr_norm": ratio("atr", "close"),
        "ema_9_21": ratio("ema9", "ema21") - 1.0,
        "close_ema50": ratio("close", "ema50") - 1.0,
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "dow": F.weekday(to_ts("ms")).cast("double"),
    })
    feature_names = list(FEATURE_COLUMNS)
    if rates is not None:
        rows = asof_backward(
            rows, rate_features(rates, keys), keys, RATE_FEATURE_COLUMNS, grid_ms=step_ms(timeframe)
        )
        feature_names = active_features(True)
    return rows.select(*bars.columns, "i", "atr", *feature_names)


def rate_features(rates: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Statistics of the last nine settlements, computed on the irregular series itself."""
    rows, w = with_halo(number_by_range(rates, keys, ["ms"]), keys, back=9)
    rows = rows.withColumns({
        "funding_now": F.col("rate"),
        "funding_mean9": rolling(w, 9, "mean", "rate"),
        "funding_z": rolling_z(w, 9, "rate"),
        "funding_cum9": rolling(w, 9, "sum", "rate"),
    })
    return drop_halo(rows).select(*keys, "ms", *RATE_FEATURE_COLUMNS)


def complete_rows(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Rows with every feature (and the label) present."""
    return df.dropna(subset=[*features, *([label] if label else [])])
