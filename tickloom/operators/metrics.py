"""Performance metrics of trades and equity curves as aggregates over chunked windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio
from tickloom.operators.chunking import drop_halo, running, with_halo

MIN_EXPOSURE_TO_RESCALE_PCT = 10.0


def sharpe(ret: Column | str, periods: float) -> Column:
    """Annualised mean over sample deviation of per-bar returns; 0 when undefined."""
    r = F.col(ret) if isinstance(ret, str) else ret
    sd = F.stddev_samp(r)
    return F.when((F.count(r) < 2) | sd.isNull() | (sd == 0), 0.0).otherwise(F.try_divide(F.avg(r), F.nullif(sd, F.lit(0.0))) * math.sqrt(periods))


def sigmas_from_zero(ret: Column | str) -> Column:
    """Standard errors between the mean return and zero; 0 below three observations."""
    r = F.col(ret) if isinstance(ret, str) else ret
    sd = F.stddev_samp(r)
    return F.when((F.count(r) < 3) | sd.isNull() | (sd == 0), 0.0).otherwise(
        F.try_divide(F.avg(r), F.nullif(sd, F.lit(0.0)) / F.sqrt(F.count(r))))


def cagr_pct(first: Column, last: Column, years: Column) -> Column:
    return F.when((years > 0) & (first > 0), (F.pow(last / first, 1.0 / years) - 1.0) * 100.0).otherwise(0.0)


def with_returns(curve: DataFrame, keys: Sequence[str], value: str = "equity") -> DataFrame:
    """Add ``ret`` (percent change to the previous row) to a curve with ordinal ``i``."""
    rows, w = with_halo(curve, keys, back=1)
    prev = F.lag(value).over(w)
    return drop_halo(rows.withColumn("ret", ratio(value, prev) - 1.0))


def with_drawdown(curve: DataFrame, keys: Sequence[str], value: str = "equity") -> DataFrame:
    """Add running ``peak`` and ``drawdown``."""
    out = running(curve, keys, {"peak": ("max", F.col(value))})
    return out.withColumn("drawdown", ratio(value, "peak") - 1.0)


def exposure(equity: Column | str = "equity", cash: Column | str = "cash") -> Column:
    """Share of the account at risk, in [0, 1]; 0 where undefined."""
    eq = F.col(equity) if isinstance(equity, str) else equity
    free = F.col(cash) if isinstance(cash, str) else cash
    share = F.coalesce(ratio(F.greatest(eq - free, F.lit(0.0)), eq), F.lit(0.0))
    return F.when(eq.isNotNull() & free.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def return_on_risked(total_return: Column, avg_exposure: Column) -> Column:
    """Return rescaled to the money at work; NULL when that would extrapolate more than tenfold."""
    return F.when(avg_exposure >= MIN_EXPOSURE_TO_RESCALE_PCT, total_return / (avg_exposure / 100.0))


def curve_summary(curve: DataFrame, keys: Sequence[str], periods: float, initial: float) -> DataFrame:
    """Return, drawdown, Sharpe, exposure per key from equity/cash rows with ordinal ``i``."""
    full = with_drawdown(with_returns(curve, keys), keys)
    x = exposure()
    agg = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        F.max_by("equity", "i").alias("final_equity"),
        (F.min("drawdown") * 100.0).alias("max_drawdown_pct"),
        sharpe("ret", periods).alias("sharpe"),
        (F.avg(x) * 100.0).alias("avg_exposure_pct"),
        (F.avg((x > 0).cast("int")) * 100.0).alias("time_in_market_pct"),
    )
    agg = agg.withColumn("total_return_pct", (F.col("final_equity") / initial - 1.0) * 100.0)
    return agg.withColumn("return_on_risked_pct", return_on_risked(F.col("total_return_pct"), F.col("avg_exposure_pct")))


def profit_factor(pnl: str = "pnl") -> Column:
    """Won over lost money; infinite without a loss."""
    won = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0))
    lost = F.sum(F.when(F.col(pnl) <= 0, F.col(pnl)).otherwise(0.0))
    return F.when(lost < 0, won / F.nullif(-lost, F.lit(0.0))).otherwise(F.lit(float("inf")))


def trade_summary(closed: DataFrame, keys: Sequence[str]) -> DataFrame:
    pnl = F.col("pnl")
    reason = lambda name: F.count_if(F.col("exit_reason") == name).alias(f"exits_{name}")
    return closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        (F.avg((pnl > 0).cast("int")) * 100.0).alias("win_rate_pct"),
        profit_factor().alias("profit_factor"),
        F.avg(pnl).alias("avg_trade_pnl"),
        F.sum("fees").alias("fees_paid"),
        (F.sum(pnl) + F.sum("fees")).alias("gross_pnl"),
        F.sum(pnl).alias("net_pnl"),
        (F.avg((F.col("exit_ms") - F.col("entry_ms")) / 3_600_000.0)).alias("avg_hours"),
        reason("tp"), reason("sl"), reason("timeout"),
        F.count_if(~F.col("exit_reason").isin("tp", "sl", "timeout")).alias("exits_other"),
    )


def exit_map(closed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exit-reason frequencies as a map; counted before they are gathered."""
    counts = closed.groupBy(*keys, "exit_reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("exit_reason", "n")))).alias("exits"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes (the two bounds are the only thing broadcast)."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor(ratio(F.col(value) - F.col("_lo"), width)), F.lit(bins - 1).cast("long"))
    tagged = df.crossJoin(F.broadcast(bounds)).withColumn("bin", F.coalesce(at, F.lit(0).cast("long")))
    return tagged.groupBy("bin").agg(
        F.first(F.col("_lo") + width * F.col("bin")).alias("bin_start"), F.count(F.lit(1)).alias("n"))


def last_per_timestamp(journal: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ms", seq: str = "seq") -> DataFrame:
    """One row per (key, timestamp): the values journaled last."""
    picked = journal.groupBy(*keys, ts).agg(F.max_by(F.struct(*values), seq).alias("_v"))
    return picked.select(*keys, ts, "_v.*")


def distinct_in_order(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Distinct values per key as an array, each at its first place; repeats combine before anything is gathered."""
    first = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    gathered = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_v"))
    return gathered.select(*keys, F.transform("_v", lambda v: v[value]).alias(f"{value}s"))


def changed_fields(history: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """Sorted distinct field names per key, joined into one text."""
    distinct = history.select(*keys, field).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(field)), ", ").alias("fields"))


def recent(df: DataFrame, days: int, keys: Sequence[str] = (), ts: str = "ms", at: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` before each key's own newest row (or one day before ``at`` if earlier)."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    joined = df.join(newest, list(keys)) if keys else df.crossJoin(F.broadcast(newest))
    edge = F.col("_newest") - days * 86_400_000
    if at is not None:
        edge = F.least(edge, at - 86_400_000)
    return joined.filter(F.col(ts) >= edge).drop("_newest")


def move_pct(bars: DataFrame, hours: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Percent move of the last close against the last close at least ``hours`` older."""
    newest = bars.groupBy(*keys).agg(F.max("ms").alias("_newest"), F.max_by("close", "ms").alias("last_close"))
    old = F.col("ms") <= F.col("_newest") - hours * 3_600_000
    return bars.join(newest, list(keys)).groupBy(*keys).agg(
        F.first("last_close").alias("last_close"),
        (ratio(F.first("last_close"), F.max_by("close", F.when(old, F.col("ms")))) * 100.0 - 100.0).alias("move_pct"),
    )
