"""Benchmark curves: baskets, buy-and-hold and the exposure-matched market."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio
from tickloom.operators.chunking import drop_halo, running, with_halo
from tickloom.operators.metrics import exposure


def number_dates(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row position of each distinct date.

    Only distinct dates reach the window: their number is bounded by the calendar span, whatever
    the table size.
    """
    w = W.partitionBy(*keys).orderBy(date)
    dates = df.select(*keys, date).distinct().withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    return dates


def dense_panel(prices: DataFrame, keys: Sequence[str] = (), date: str = "date", symbol: str = "symbol", value: str = "close") -> DataFrame:
    """Full outer alignment of all symbols on all dates, forward filled, with row position ``i``.

    A symbol has one row per date, so its forward-fill partition is bounded by the calendar.
    """
    # one row per panel holds its calendar; every symbol unfolds it, no table is multiplied with another
    grid = number_dates(prices, date, keys).groupBy(*keys).agg(F.collect_list(F.struct("i", date)).alias("_calendar"))
    names = prices.select(*keys, symbol).distinct()
    cells = names.join(F.broadcast(grid), list(keys)) if keys else names.crossJoin(F.broadcast(grid))
    cells = cells.select(*keys, symbol, F.inline("_calendar"))
    full = cells.join(prices.select(*keys, date, symbol, value), [*keys, date, symbol], "left")
    w = W.partitionBy(*keys, symbol).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return full.withColumn(value, F.last(value, ignorenulls=True).over(w))


def breadth(panel: DataFrame, min_names: int, date: str = "date", value: str = "close") -> DataFrame:
    """Dates on which at least ``min_names`` symbols are quoted."""
    enough = panel.groupBy(date).agg(F.count(value).alias("_names")).filter(F.col("_names") >= min_names)
    return panel.join(enough.select(date), date, "left_semi")


def complete_dates(panel: DataFrame, date: str = "date", symbol: str = "symbol", value: str = "close") -> DataFrame:
    """Dates on which every symbol has a price."""
    total = panel.select(symbol).distinct().agg(F.count(F.lit(1)).alias("_all"))
    per_date = panel.groupBy(date).agg(F.count(value).alias("_names"))
    full = per_date.crossJoin(F.broadcast(total)).filter(F.col("_names") == F.col("_all"))
    return panel.join(full.select(date), date, "left_semi")


def basket_curve(panel: DataFrame, initial: float, keys: Sequence[str] = (), weights: DataFrame | None = None,
                 order: str = "i", value: str = "close", symbol: str = "symbol") -> DataFrame:
    """Buy the names live on the first row (equally or by weight) and hold."""
    first = panel.groupBy(*keys).agg(F.min(order).alias("_first"))
    base = panel.join(first, list(keys)) if keys else panel.crossJoin(F.broadcast(first))
    start = base.filter((F.col(order) == F.col("_first")) & (F.col(value) > 0)).select(*keys, symbol, F.col(value).alias("_p0"))
    held = panel.join(start, [*keys, symbol])
    growth = F.col(value) / F.col("_p0")
    if weights is None:
        return held.groupBy(*keys, order).agg((F.avg(growth) * initial).alias("equity"))
    held = held.join(weights, [c for c in weights.columns if c != "weight"])
    return held.groupBy(*keys, order).agg((F.sum(growth * F.col("weight")) * initial).alias("equity"))


def matched_exposure(market: DataFrame, account: DataFrame, initial: float, keys: Sequence[str] = ()) -> DataFrame:
    """The market ridden with the book's own exposure of the bar before.

    ``market``: (keys, symbol, i, close) dense and forward filled; ``account``: (keys, i, equity, cash)
    on some of those rows.
    """
    rows, w = with_halo(market, [*keys, "symbol"], back=1)
    moves = drop_halo(rows.withColumn("_chg", ratio("close", F.lag("close").over(w)) - 1.0))
    basket = moves.groupBy(*keys, "i").agg(F.coalesce(F.avg("_chg"), F.lit(0.0)).alias("basket"))
    at = account.select(*keys, "i", exposure().alias("_x"))
    filled = running(basket.join(at, [*keys, "i"], "left"), keys, {"exposure": ("last", F.col("_x"))})
    rows, w = with_halo(filled, keys, back=1)
    held = F.coalesce(F.lag("exposure").over(w), F.lit(0.0))
    growth = drop_halo(rows.withColumn("_growth", 1.0 + held * F.col("basket")))
    out = running(growth, keys, {"_curve": ("prod", F.col("_growth"))})
    return out.withColumn("equity", F.col("_curve") * initial).select(*keys, "i", "basket", F.coalesce("exposure", F.lit(0.0)).alias("exposure"), "equity")
