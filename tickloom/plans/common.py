"""Shared pieces of the registered queries: output rounding and SQL building blocks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.timeframes import TIMEFRAME_MS


_SHARED: dict = {}


def shared(df_key: tuple, build) -> DataFrame:
    """A stage many queries start from, kept by Spark's cache for the life of the session.

    Cached partitions keep their lineage, so a lost executor only costs a recomputation.
    """
    frame = _SHARED.get(df_key)
    if frame is None:
        frame = _SHARED[df_key] = build().persist()
    return frame


def forget_shared() -> None:
    """Release every kept stage; the next query that needs one builds it from the files."""
    for frame in _SHARED.values():
        frame.unpersist()
    _SHARED.clear()


def rounded(df: DataFrame, digits: int = 6, skip: Iterable[str] = ()) -> DataFrame:
    """Doubles rounded for comparison across engines (and -0.0 folded into 0.0)."""
    return df.select(*[
        (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes
    ])


TICKS = "ticks AS (SELECT event_type AS symbol, ts, epoch_us(ts) // 1000 AS ms, value AS price, event_id FROM events)"


def bars_cte(timeframe: str = "1h", name: str = "bars") -> str:
    step = TIMEFRAME_MS[timeframe]
    return (
        f"{name} AS (SELECT symbol, ms - ms % {step} AS ms, first(price ORDER BY ts, event_id) AS open, max(price) AS high, "
        f"min(price) AS low, last(price ORDER BY ts, event_id) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2)"
    )


def to_ts_sql(expr: str) -> str:
    return f"make_timestamp(({expr}) * 1000)"


HASH = "('0x' || substr(md5(concat_ws('|', {args})), 1, 8))::bigint / 4294967296.0::double"


def hashed_sql(*args: str) -> str:
    return HASH.format(args=", ".join(f"({a})::varchar" for a in args))


NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ms) - 1 AS i FROM bars)"

# Exponentially weighted means by a recursive walk over each symbol's bars.
EWM = """
pre AS (SELECT n.*, lag(close) OVER s AS pc, close - lag(close) OVER s AS d FROM n WINDOW s AS (PARTITION BY symbol ORDER BY i)),
inp AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, greatest(d, 0.0) AS up, greatest(-d, 0.0) AS dn FROM pre),
walk AS (
  SELECT symbol, i, close AS e9, close AS e21, close AS e50, (high - low) AS tr_e, NULL::double AS g_e, NULL::double AS l_e FROM inp WHERE i = 0
  UNION ALL
  SELECT x.symbol, x.i, w.e9 * (1 - 2.0::double / 10) + x.close * (2.0::double / 10), w.e21 * (1 - 2.0::double / 22) + x.close * (2.0::double / 22),
         w.e50 * (1 - 2.0::double / 51) + x.close * (2.0::double / 51),
         w.tr_e * (1 - 1.0::double / 14) + x.tr * (1.0::double / 14),
         CASE WHEN x.i = 1 THEN x.up ELSE w.g_e * (1 - 1.0::double / 14) + x.up * (1.0::double / 14) END,
         CASE WHEN x.i = 1 THEN x.dn ELSE w.l_e * (1 - 1.0::double / 14) + x.dn * (1.0::double / 14) END
  FROM walk w JOIN inp x ON x.symbol = w.symbol AND x.i = w.i + 1
),
ind AS (
  SELECT inp.*, e9 AS ema9, e21 AS ema21, e50 AS ema50, CASE WHEN inp.i >= 13 THEN tr_e END AS atr,
         CASE WHEN inp.i >= 14 AND l_e <> 0 THEN 100.0 - 100.0 / (1.0 + g_e / l_e) ELSE 50.0 END AS rsi
  FROM inp JOIN walk USING (symbol, i)
)"""


def indicators_cte(timeframe: str = "1h") -> str:
    return f"WITH RECURSIVE {TICKS}, {bars_cte(timeframe)}, {NUMBERED}, {EWM.strip()}"


SCORED = (
    f"scored AS (SELECT ind.*, {hashed_sql(repr('L'), 'symbol', 'ms')} AS p_long, {hashed_sql(repr('S'), 'symbol', 'ms')} AS p_short FROM ind)"
)
