"""Streaming bar closing, deduplication, gap alarms and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.timeframes import step_ms


def closed_bars(ticks: DataFrame, timeframe: str, delay: str = "0 seconds") -> DataFrame:
    """Bars emitted once the watermark passes their end (append mode).

    Input: symbol, ts TIMESTAMP, price, event_id. State is one aggregate per open bar.
    """
    width = f"{step_ms(timeframe)} milliseconds"
    at = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", width).alias("_w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))
        .select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def new_bars_only(bars: DataFrame, delay: str) -> DataFrame:
    """Drop repeated (symbol, ts) bars and those later than the watermark allows."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def fan_out(bars: DataFrame, variants: DataFrame, base: dict[str, float]) -> DataFrame:
    """Every bar once per variant; a variant's missing override falls back to the base value."""
    settings = variants.select("variant", *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in base.items()])
    return bars.crossJoin(F.broadcast(settings))


def latest_prices(ticks: DataFrame) -> DataFrame:
    """Newest price per symbol (update mode)."""
    return ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))


def mark_to_market(holdings: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: value the holdings at the prices of the batch."""
    def value(batch: DataFrame, batch_id: int) -> None:
        marked = holdings.join(batch, "symbol").withColumn("value", F.col("qty") * F.col("price"))
        sink(marked.groupBy("book").agg(F.sum("value").alias("value"), F.max("ts").alias("ts")), batch_id)
    return value


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body that journals a batch under its own id, so a replayed batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


GAP_STATE = "last_ms long, open boolean"
GAP_OUT = "symbol string, kind string, at timestamp, missing long"


def gap_alarms(bars: DataFrame, timeframe: str, delay: str = "0 seconds") -> DataFrame:
    """'outage' when no bar came for two bar lengths of event time, 'recovery' with the next bar."""
    step = step_ms(timeframe)

    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, (last, is_open) = [], state.get if state.exists else (None, False)
        if state.hasTimedOut:
            if not is_open and last is not None:
                rows.append((key[0], "outage", last + 2 * step, None))
                state.update((last, True))
        else:
            times = sorted(int(t.value // 1_000_000) for b in batches for t in b["ts"])
            for ms in times:
                if last is not None and ms <= last:
                    continue
                if last is not None and ms - last > 2 * step and not is_open:
                    rows.append((key[0], "outage", last + 2 * step, None))
                    is_open = True
                if is_open:
                    rows.append((key[0], "recovery", ms, (ms - last) // step - 1))
                    is_open = False
                last = ms
            state.update((last, is_open))
            due = last + 3 * step  # silent two bar lengths after the bar's own close
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        out = pd.DataFrame(rows, columns=["symbol", "kind", "at", "missing"])
        out["at"] = pd.to_datetime(out["at"], unit="ms", utc=True).dt.tz_localize(None)
        out["missing"] = out["missing"].astype("Int64")
        yield out

    return bars.withWatermark("ts", delay).groupBy("symbol").applyInPandasWithState(
        track, GAP_OUT, GAP_STATE, "append", GroupStateTimeout.EventTimeTimeout)
