"""Ticks to bars, coarser bars, gaps, closed bars, merges, fetch plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom.functions.timeframes import floor_ms, step_ms, to_ts
from tickloom.operators.chunking import drop_halo, number_on_grid, with_halo

OHLCV = ["open", "high", "low", "close", "volume"]


def ticks_to_bars(
    ticks: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",), price: str = "price",
    order: Sequence[str] = ("ts", "event_id"), volume: Column | None = None,
) -> DataFrame:
    """Left-closed, left-labelled bars; empty bars do not exist.

    One hash aggregation with map-side combine: first/last are min_by/max_by over an explicit
    order, so a hot symbol or a hot hour only contributes one partial row per map task.
    """
    at = F.struct(*order)
    return (
        ticks.withColumn("_bar", floor_ms("ms", step_ms(timeframe)))
        .groupBy(*keys, F.col("_bar").alias("ms"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            (F.count(F.lit(1)) if volume is None else F.sum(volume)).alias("volume"),
        )
    )


def resample(bars: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars to a coarser grid."""
    return (
        bars.withColumn("_bar", floor_ms("ms", step_ms(timeframe)))
        .groupBy(*keys, F.col("_bar").alias("ms"))
        .agg(
            F.min_by("open", "ms").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ms").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def with_ts(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ts", to_ts("ms"))


def gaps(bars: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Holes longer than one step: last bar before, first bar after, bars missing."""
    step = step_ms(timeframe)
    chunked, w = with_halo(number_on_grid(bars.select(*keys, "ms"), keys, step), keys, back=1)
    found = drop_halo(chunked.withColumn("_prev", F.lag("ms").over(w)))
    return found.filter(F.col("ms") - F.col("_prev") > step).select(
        *keys,
        to_ts("_prev").alias("gap_start"),
        to_ts("ms").alias("gap_end"),
        (F.floor((F.col("ms") - F.col("_prev")) / step) - 1).cast("long").alias("missing"),
    )


def closed_bars(bars: DataFrame, timeframe: str, now_ms: Column | int) -> DataFrame:
    """Only bars whose interval has ended at ``now_ms``."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return bars.filter(F.col("ms") < floor_ms(now, step_ms(timeframe)))


def merge_keep_existing(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("symbol", "ms")
) -> DataFrame:
    """Union on the key; a stored row beats an incoming one with the same key.

    Expressed as an aggregation (not a window) so duplicates combine map-side.
    """
    tagged = stored.withColumn("_prio", F.lit(0)).unionByName(
        incoming.withColumn("_prio", F.lit(1)), allowMissingColumns=True
    )
    values = [c for c in tagged.columns if c not in {*keys, "_prio"}]
    picked = tagged.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct("_prio", *values)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*stored.columns)


def fetch_ranges(
    requested: DataFrame, bars: DataFrame, timeframe: str, now_ms: Column, days: int,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Ranges still to download per key: everything when cold, else backfill and forward."""
    step = step_ms(timeframe)
    since = now_ms - F.lit(days * 86_400_000)
    span = bars.groupBy(*keys).agg(F.min("ms").alias("_lo"), F.max("ms").alias("_hi"))
    cold = F.when(F.col("_lo").isNull(), F.struct(F.lit("cold").alias("kind"), since.alias("from_ms"), now_ms.alias("to_ms")))
    backfill = F.when(F.col("_lo") > since, F.struct(F.lit("backfill").alias("kind"), since.alias("from_ms"), F.col("_lo").alias("to_ms")))
    forward = F.when(
        F.col("_hi") + step < now_ms,
        F.struct(F.lit("forward").alias("kind"), (F.col("_hi") + step).alias("from_ms"), now_ms.alias("to_ms")),
    )
    ranges = F.filter(F.array(cold, backfill, forward), lambda r: r.isNotNull())
    return requested.join(span, list(keys), "left").select(*keys, F.explode(ranges).alias("_r")).select(*keys, "_r.*")


def decode_raw(raw: DataFrame, column: str = "rows", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``[[ms, o, h, l, c, v], ...]`` arrays to typed bar rows."""
    row = F.col("_r")
    fields = [row[k + 1].cast("double").alias(name) for k, name in enumerate(OHLCV)]
    return raw.select(*keys, F.explode(column).alias("_r")).select(*keys, row[0].cast("long").alias("ms"), *fields)


def tail(bars: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last ``n`` rows per key; the limit is applied map-side before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.desc("ms"))
    return bars.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
