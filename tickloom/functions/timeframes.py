"""Bar lengths and annualisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bar lengths in milliseconds.
TIMEFRAME_MS = {
    "1m": 60_000,
    "5m": 300_000,
    "15m": 900_000,
    "1h": 3_600_000,
    "4h": 14_400_000,
    "1d": 86_400_000,
}
MS_PER_YEAR = 365 * 86_400_000


def step_ms(timeframe: str) -> int:
    return TIMEFRAME_MS[timeframe]


def periods_per_year(timeframe: str) -> float:
    return MS_PER_YEAR / TIMEFRAME_MS[timeframe]


def epoch_ms(ts: Column | str) -> Column:
    """Epoch milliseconds of a wall-clock timestamp (session zone UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(col.cast("timestamp"))


def to_ts(ms: Column | str) -> Column:
    col = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_millis(col).cast("timestamp_ntz")


def floor_ms(ms: Column | str, step: int) -> Column:
    col = F.col(ms) if isinstance(ms, str) else ms
    return col - F.pmod(col, F.lit(step))
