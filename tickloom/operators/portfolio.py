"""Portfolio tables (book, symbol, date): weights, drift, orders, settlement, schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import Costs

MIN_QTY = 1e-9


def base_weights(targets: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    """Weights scaled to sum to one (an all-zero book stays zero)."""
    total = targets.groupBy(*keys).agg(F.sum("weight").alias("_sum"))
    scale = F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum"))
    return targets.join(total, list(keys)).withColumn("weight", F.col("weight") / scale).drop("_sum")


def trend_weights(panel: DataFrame, weights: DataFrame, ma_days: int, safe: str | None) -> DataFrame:
    """Weights per row after the trend filter: a name below its average hands its weight over.

    Before ``ma_days`` rows the base weights apply; without a safe asset the weight stays in cash.
    """
    w = W.partitionBy("symbol").orderBy("i")
    frame = w.rowsBetween(-(ma_days - 1), 0)
    judged = panel.withColumn("_ma", F.avg("close").over(frame)).join(weights, "symbol")
    below = (F.col("i") + 1 >= ma_days) & (F.col("close") < F.col("_ma"))
    owner = F.when(below, F.lit(safe)).otherwise(F.col("symbol"))
    moved = judged.withColumn("_owner", owner).filter(F.col("_owner").isNotNull())
    return moved.groupBy("i", F.col("_owner").alias("symbol")).agg(F.sum("weight").alias("weight"))


def valued(holdings: DataFrame, cash: DataFrame, prices: DataFrame, targets: DataFrame | None = None,
           keys: Sequence[str] = ("book",)) -> DataFrame:
    """Holdings united with targets, priced (missing price or side = 0), with the book total."""
    keys = list(keys)
    rows = holdings.select(*keys, "symbol", "qty")
    if targets is not None:
        rows = rows.join(targets.select(*keys, "symbol", "weight"), [*keys, "symbol"], "full")
        rows = rows.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    rows = rows.join(prices, "symbol", "left").withColumns({
        "qty": F.coalesce("qty", F.lit(0.0)), "price": F.coalesce("price", F.lit(0.0))})
    rows = rows.withColumn("value", F.col("qty") * F.col("price"))
    total = rows.groupBy(*keys).agg(F.sum("value").alias("_held")).join(cash, keys)
    total = total.select(*keys, "cash", (F.col("_held") + F.col("cash")).alias("total"))
    return rows.join(total, keys)


def portfolio_value(valued_rows: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    return valued_rows.groupBy(*keys).agg(F.first("total").alias("total"))


def current_weights(valued_rows: DataFrame) -> DataFrame:
    """Share per holding; a book worth nothing has none."""
    return valued_rows.filter(F.col("total") > 0).withColumn("current", F.col("value") / F.col("total"))


def drift(valued_rows: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    """Largest gap between current and target weight in points, and the symbol that has it."""
    gap = F.when(F.col("total") > 0, F.abs(F.col("value") / F.nullif("total", F.lit(0.0)) - F.col("weight"))).otherwise(0.0) * 100.0
    return valued_rows.withColumn("_gap", gap).groupBy(*keys).agg(
        F.max("_gap").alias("max_drift_pp"), F.max_by("symbol", F.struct("_gap", "symbol")).alias("worst_symbol"))


def rebalance_due(days: Column, drift_pp: Column, cadence: int, band_pp: float) -> Column:
    return (days >= cadence) | (drift_pp >= band_pp)


def orders(valued_rows: DataFrame, min_value: float = 1.0) -> DataFrame:
    """Orders towards the targets; unpriced symbols and small moves are skipped."""
    delta = F.col("weight") * F.col("total") - F.col("value")
    rows = valued_rows.withColumn("_delta", delta).filter((F.col("price") > 0) & (F.abs("_delta") >= min_value))
    return rows.withColumns({
        "side": F.when(F.col("_delta") > 0, "buy").otherwise("sell"), "order_qty": F.abs("_delta") / F.col("price"),
    }).drop("_delta")


def settle(order_rows: DataFrame, costs: Costs, keys: Sequence[str] = ("book",)) -> DataFrame:
    """Executed fills: sells first and capped by the holding, buys capped by the cash that is left.

    Wants are positive and served in order, so what one buy gets is its want clipped by cash minus
    the wants before it: a running sum instead of a loop over orders. A book has one order per symbol at most, so
    one window over the book does it.
    """
    keys = list(keys)
    is_buy = F.col("side") == "buy"
    eff = F.when(is_buy, F.col("price") * (1 + costs.slippage)).otherwise(F.col("price") * (1 - costs.slippage))
    rows = order_rows.withColumns({
        "fill_price": eff, "_sold": F.when(~is_buy, F.least("order_qty", "qty")).otherwise(0.0), "_late": is_buy.cast("int")})
    proceeds = F.when(F.col("_sold") > MIN_QTY, F.col("_sold") * F.col("fill_price") * (1 - costs.taker_fee)).otherwise(0.0)
    want = F.when(is_buy, F.col("order_qty") * F.col("fill_price") * (1 + costs.taker_fee)).otherwise(0.0)
    book = W.partitionBy(*keys)
    served = book.orderBy("_late", "symbol").rowsBetween(W.unboundedPreceding, 0)
    asked = rows.withColumns({"_want": want, "_got": proceeds}).withColumns({
        "_upto": F.sum("_want").over(served), "_proceeds": F.sum("_got").over(book.orderBy("_late", "symbol").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    left = F.greatest(F.lit(0.0), F.col("cash") + F.col("_proceeds") - (F.col("_upto") - F.col("_want")))
    bought = F.least("_want", left) / (F.col("fill_price") * (1 + costs.taker_fee))
    out = asked.withColumn("filled_qty", F.when(is_buy, bought).otherwise(F.col("_sold"))).filter(F.col("filled_qty") > MIN_QTY)
    out = out.withColumn("notional", F.col("filled_qty") * F.col("fill_price"))
    return out.withColumn("fee", F.col("notional") * costs.taker_fee).drop("_sold", "_late", "_want", "_got", "_upto", "_proceeds")


def cash_after(fills: DataFrame, cash: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    flow = F.when(F.col("side") == "sell", F.col("notional") - F.col("fee")).otherwise(-F.col("notional") - F.col("fee"))
    moved = fills.groupBy(*keys).agg(F.sum(flow).alias("_flow"))
    return cash.join(moved, list(keys), "left").select(*keys, (F.col("cash") + F.coalesce("_flow", F.lit(0.0))).alias("cash"))


def rebalance_schedule(panel: DataFrame, targets: DataFrame, cadence: int, band_pp: float, clock: str = "rows") -> DataFrame:
    """Rows on which the book rebalances: cadence reached or drift band broken since the last time.

    Every row is tried as an anchor and gets the first later row that would trigger; the real
    anchors are then followed from row 0. Anchor-to-row pairs stay within one cadence, so the
    work is dates * cadence * symbols, and dates are bounded by the calendar. ``clock`` counts
    rows (batch convention) or calendar days (live convention).
    """
    priced = panel.select("i", "date", "symbol", "close")
    dates = panel.select("i", "date").distinct()
    anchors = priced.join(targets, ["i", "symbol"]).select(
        F.col("i").alias("a"), F.col("date").alias("a_date"), "symbol", F.col("weight").alias("w0"), F.col("close").alias("p0"))
    later = dates.select(F.col("i").alias("t"), F.col("date").alias("t_date"))
    ahead = anchors.withColumn("t", F.explode(F.sequence(F.col("a") + 1, F.col("a") + cadence))).join(later, "t")
    now = ahead.join(priced.select(F.col("i").alias("t"), "symbol", "close"), ["t", "symbol"])
    goal = targets.select(F.col("i").alias("t"), "symbol", F.col("weight").alias("goal"))
    moved = now.join(goal, ["t", "symbol"], "left").withColumn("_v", F.col("w0") * F.col("close") / F.col("p0"))
    totals = moved.groupBy("a", "t").agg((F.sum("_v") + 1.0 - F.sum("w0")).alias("_total"))
    gap = F.abs(F.col("_v") / F.col("_total") - F.coalesce("goal", F.lit(0.0))) * 100.0
    per_pair = moved.join(totals, ["a", "t"]).groupBy("a", "t").agg(
        F.max(gap).alias("drift_pp"), F.first("a_date").alias("a_date"), F.first("t_date").alias("t_date"))
    elapsed = F.col("t") - F.col("a") if clock == "rows" else F.date_diff("t_date", "a_date")
    due = per_pair.filter(rebalance_due(elapsed, F.col("drift_pp"), cadence, band_pp))
    jump = due.groupBy("a").agg(F.min("t").alias("t"), F.min_by("drift_pp", "t").alias("drift_pp"))
    # one entry per calendar row: follow the jumps from row 0
    table = jump.agg(F.sort_array(F.collect_list(F.struct("a", "t", "drift_pp"))).alias("_jumps"))
    start = F.expr("named_struct('at', 0L, 'hit', cast(array() as array<struct<i:bigint,drift_pp:double>>))")
    walked = F.aggregate("_jumps", start, lambda acc, j: F.when(j["a"] == acc["at"], F.struct(
        j["t"].cast("long").alias("at"), F.concat(acc["hit"], F.array(F.struct(j["t"].cast("long").alias("i"), j["drift_pp"].alias("drift_pp")))).alias("hit"),
    )).otherwise(acc))
    hits = table.select(F.explode(walked["hit"]).alias("_h")).select("_h.*")
    first = dates.filter(F.col("i") == 0).select("i", F.lit(None).cast("double").alias("drift_pp"))
    return first.unionByName(hits)
