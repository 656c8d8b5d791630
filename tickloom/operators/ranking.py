"""Cross-sectional ranking: scores, legs, target weights, and the curve of a rebalanced book.

Panels are long tables (keys, i, date, symbol, close) with one row per date and symbol, so any
per-symbol or per-curve window is bounded by the calendar; the wide dimension (symbols on one
date) is only ever aggregated or cut by a top-k that Catalyst applies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio
from tickloom.operators.metrics import sharpe, sigmas_from_zero
from tickloom.session import durable


def split_windows(panel: DataFrame, n_windows: int, warmup: int, min_tradable: int = 60, keys: Sequence[str] = (),
                  with_whole: bool = True) -> DataFrame:
    """Copy rows into disjoint windows (1..n), each with its warm-up prefix; 0 is the whole period.

    Too short a history collapses to one window. ``i`` restarts in every window.
    """
    sizes = panel.groupBy(*keys).agg((F.max("i") + 1).alias("_n"))
    usable = F.col("_n") - warmup
    enough = usable >= n_windows * max(1, min_tradable)
    size = F.floor(usable / n_windows).cast("long")
    cut = F.transform(F.sequence(F.lit(1), F.lit(n_windows)), lambda k: F.struct(
        k.cast("int").alias("window"), ((k - 1) * size).alias("start"), ((k - 1) * size + warmup + size).alias("stop")))
    whole = lambda w: F.struct(F.lit(w).alias("window"), F.lit(0).cast("long").alias("start"), F.col("_n").cast("long").alias("stop"))
    spans = F.when(enough, cut).otherwise(F.array(whole(1)))
    if with_whole:
        spans = F.concat(spans, F.array(whole(0)))
    table = sizes.select(*keys, F.explode(spans).alias("_w")).select(*keys, "_w.*")
    # n_windows + 1 rows per panel key
    joined = panel.join(F.broadcast(table), list(keys)) if keys else panel.crossJoin(F.broadcast(table))
    inside = joined.filter((F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop")))
    return inside.withColumn("i", F.col("i") - F.col("start")).drop("start", "stop")


def momentum(panel: DataFrame, lookback: int, skip: int, keys: Sequence[str] = (), extra_lag: int = 0) -> DataFrame:
    """Return from ``lookback + skip`` rows ago to ``skip`` rows ago; ``extra_lag`` shifts both back."""
    w = W.partitionBy(*keys, "symbol").orderBy("i")
    end, start = F.lag("close", skip + extra_lag).over(w), F.lag("close", skip + lookback + extra_lag).over(w)
    return panel.withColumn("score", ratio(end, start) - 1.0)


def select_legs(scores: DataFrame, n_long: int, n_short: int, keys: Sequence[str] = ("i",)) -> DataFrame:
    """Strongest ``n_long`` and weakest ``n_short`` names per key, never overlapping (leg 1 / -1).

    Both cuts are ``row_number <= k`` filters, which run as a map-side group limit first.
    """
    named = scores.filter(F.col("score").isNotNull())
    sizes = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    best = W.partitionBy(*keys).orderBy(F.desc("score"), "symbol")
    worst = W.partitionBy(*keys).orderBy("score", F.desc("symbol"))
    top = named.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= n_long).withColumn("leg", F.lit(1))
    if n_short <= 0:
        return top.drop("_rn")
    low = named.withColumn("_rn", F.row_number().over(worst)).filter(F.col("_rn") <= n_short)
    room = F.col("_n") - F.least(F.lit(n_long), F.col("_n"))
    low = low.join(sizes, list(keys)).filter(F.col("_rn") <= room).drop("_n").withColumn("leg", F.lit(-1))
    return top.unionByName(low).drop("_rn")


def leg_weights(legs: DataFrame, direction: str, keys: Sequence[str] = ("i",)) -> DataFrame:
    """Equal weights per leg: long_only fills 100 %, long_short half on each side."""
    if direction not in ("long_only", "long_short"):
        raise ValueError(f"unknown direction {direction!r}")
    used = legs.filter(F.col("leg") > 0) if direction == "long_only" else legs
    sizes = used.groupBy(*keys, "leg").agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("leg") * (1.0 if direction == "long_only" else 0.5) / F.col("_n")
    return used.join(sizes, [*keys, "leg"]).withColumn("weight", share).drop("_n")


def scheduled_weights(panel: DataFrame, lookback: int, skip: int, every: int, n_long: int, n_short: int,
                      direction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weights per rebalance row from prices that end one row earlier, for names tradable on that row."""
    warmup = lookback + skip + 1
    scored = momentum(panel, lookback, skip, keys, extra_lag=1)
    due = scored.filter((F.col("i") >= warmup) & ((F.col("i") - warmup) % every == 0))
    legs = select_legs(due, n_long, n_short if direction == "long_short" else 0, [*keys, "i"])
    weights = leg_weights(legs, direction, [*keys, "i"])
    return weights.filter(F.col("close") > 0).select(*keys, "i", "symbol", "weight", F.col("close").alias("price"))


def rebalanced_curve(panel: DataFrame, weights: DataFrame, rate: float, initial: float, keys: Sequence[str] = (),
                     first_row: int = 0, daily_drag: float = 0.0) -> DataFrame:
    """Equity of a book set to ``weights`` on its rebalance rows and drifting in between.

    Inside a segment equity is E_k * (1 - sum w - c_k + sum w * P_i / P_k): an equi-join of rows with
    their segment's weights and one aggregation per row. Only the costs chain across segments
    (a turnover depends on the drifted book, which paid the cost before); that chain folds over
    rebalances times legs, a size set by the schedule and not by the data. Columns: equity, gross,
    net, turnover (share of equity traded on rebalance rows), cost.
    """
    keys = list(keys)
    in_order = W.partitionBy(*keys).orderBy("i")
    upto = in_order.rowsBetween(W.unboundedPreceding, 0)
    weights = durable(weights.select(*keys, "i", "symbol", "weight", "price"))
    priced = panel.select(*keys, "i", "symbol", "close")
    rebalances = weights.select(*keys, "i").distinct().withColumn("next_i", F.lead("i").over(in_order))
    rows = priced.select(*keys, "i").distinct().filter(F.col("i") >= first_row)
    rows = rows.join(rebalances.select(*keys, "i", F.col("i").alias("seg")), [*keys, "i"], "left")
    rows = rows.withColumn("seg", F.last("seg", ignorenulls=True).over(upto))

    # every row is valued in its own segment, a rebalance row also in the one it closes
    valued = rows.filter(F.col("seg").isNotNull()).select(*keys, "i", "seg", F.lit(False).alias("closes"))
    closing = rebalances.filter(F.col("next_i").isNotNull()).select(*keys, F.col("next_i").alias("i"), F.col("i").alias("seg"), F.lit(True).alias("closes"))
    held = weights.select(*keys, F.col("i").alias("seg"), "symbol", "weight", F.col("price").alias("_p0"))
    cells = valued.unionByName(closing).join(held, [*keys, "seg"]).join(priced, [*keys, "i", "symbol"])
    cells = cells.withColumn("_v", F.col("weight") * F.col("close") / F.col("_p0"))
    per_row = cells.groupBy(*keys, "seg", "i", "closes").agg(
        F.sum("_v").alias("net"), F.sum(F.abs("_v")).alias("gross"), (1.0 - F.sum("weight") + F.sum("_v")).alias("growth"))
    if daily_drag:
        # holdings are charged every evening; the row closing a segment is marked before its charge
        since = W.partitionBy(*keys, "seg").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
        charged = F.sum("net").over(since) - F.when(F.col("closes"), F.col("net")).otherwise(0.0)
        per_row = per_row.withColumn("growth", F.col("growth") - charged * daily_drag)
    per_row = durable(per_row)  # one row per date and curve; read by each step below

    # cost chain: per rebalance the pairs (new weight, drifted old weight before division by growth)
    ends = rebalances.filter(F.col("next_i").isNotNull())
    drifted = weights.join(ends, [*keys, "i"]).select(*keys, F.col("next_i").alias("i"), "symbol", "weight", F.col("price").alias("_p0"))
    drifted = drifted.join(priced, [*keys, "i", "symbol"]).select(*keys, "i", "symbol", (F.col("weight") * F.col("close") / F.col("_p0")).alias("_old"))
    pairs = weights.select(*keys, "i", "symbol", "weight").join(drifted, [*keys, "i", "symbol"], "full")
    pairs = pairs.groupBy(*keys, "i").agg(F.collect_list(F.struct(
        F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("_old", F.lit(0.0)).alias("v"))).alias("pairs"))
    grown = per_row.filter("closes").select(*keys, "i", F.col("growth").alias("g"))
    steps = pairs.join(grown, [*keys, "i"], "left").select(*keys, F.struct("i", "g", "pairs").alias("_s"))
    chain = steps.groupBy(*keys).agg(F.sort_array(F.collect_list("_s")).alias("_steps"))
    folded = F.aggregate("_steps", F.expr("cast(array() as array<struct<i:bigint,g:double,turnover:double,cost:double>>)"),
                         lambda acc, s: F.concat(acc, F.array(_rebalance_cost(acc, s, rate))))
    costs = chain.select(*keys, F.explode(folded).alias("_c")).select(*keys, "_c.*")
    # equity right before each rebalance: product of the closed segments' growth after their cost
    factor = F.coalesce(F.col("g") - F.lag("cost").over(in_order), F.lit(1.0))
    costs = costs.withColumn("_factor", factor).withColumn("_start", F.product("_factor").over(upto) * initial)
    costs = durable(costs.select(*keys, F.col("i").alias("seg"), "turnover", "cost", "_start"))

    own = per_row.filter(~F.col("closes")).join(costs, [*keys, "seg"]).withColumn("growth", F.col("growth") - F.col("cost"))
    at_rebalance = F.col("i") == F.col("seg")
    own = own.select(
        *keys, "i", (F.col("_start") * F.col("growth")).alias("equity"), (F.col("gross") / F.col("growth") * 100.0).alias("gross_pct"),
        (F.col("net") / F.col("growth") * 100.0).alias("net_pct"), F.when(at_rebalance, F.col("turnover") * F.col("_start")).alias("traded"),
        F.when(at_rebalance, F.col("cost") * F.col("_start")).alias("cost"))
    before = rows.filter(F.col("seg").isNull()).select(
        *keys, "i", F.lit(float(initial)).alias("equity"), F.lit(0.0).alias("gross_pct"), F.lit(0.0).alias("net_pct"))
    return own.unionByName(before, allowMissingColumns=True)


def _rebalance_cost(acc: Column, s: Column, rate: float) -> Column:
    paid = F.when(F.size(acc) > 0, F.element_at(acc, -1)["cost"]).otherwise(F.lit(0.0))
    growth = F.coalesce(s["g"] - paid, F.lit(1.0))
    turnover = F.aggregate(s["pairs"], F.lit(0.0), lambda t, p: t + F.abs(p["w"] - p["v"] / growth))
    return F.struct(s["i"].cast("long").alias("i"), s["g"].alias("g"), turnover.alias("turnover"), (turnover * rate).alias("cost"))


def curve_report(curve: DataFrame, dates: DataFrame, benchmark: DataFrame, keys: Sequence[str], bars_per_year: float,
                 initial: float, direction: Column) -> DataFrame:
    """Summary row per curve: return, Sharpe, drawdown, hurdle by direction, distance from luck."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("i")
    full = curve.join(dates, [c for c in dates.columns if c in curve.columns])
    full = full.withColumns({
        "_ret": ratio("equity", F.lag("equity").over(w)) - 1.0,
        "_dd": ratio("equity", F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0))) - 1.0,
    })
    agg = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.count("cost").alias("n_rebalances"), F.max_by("equity", "i").alias("_last"),
        F.date_diff(F.max("date"), F.min("date")).alias("_days"), sharpe("_ret", bars_per_year).alias("sharpe"),
        (F.min("_dd") * 100.0).alias("max_drawdown_pct"), sigmas_from_zero("_ret").alias("sigmas_from_zero"),
        F.avg("gross_pct").alias("avg_gross_pct"), F.avg("net_pct").alias("avg_net_pct"),
        (F.coalesce(F.sum("traded"), F.lit(0.0)) / initial).alias("turnover_x_capital"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("fees_paid"))
    bench = benchmark.groupBy(*[k for k in keys if k in benchmark.columns]).agg(F.max_by("equity", "i").alias("_bench"))
    joined = agg.join(bench, [k for k in keys if k in benchmark.columns]) if any(k in benchmark.columns for k in keys) else agg.crossJoin(F.broadcast(bench))
    years = F.greatest(F.col("_days") / 365.25, F.lit(1e-9))
    total, bench_pct = (F.col("_last") / initial - 1.0) * 100.0, (F.col("_bench") / initial - 1.0) * 100.0
    hurdle = F.when(direction == "long_only", bench_pct).otherwise(0.0)
    return joined.withColumns({
        "total_return_pct": total, "cagr_pct": (F.pow(F.col("_last") / initial, 1.0 / years) - 1.0) * 100.0,
        "benchmark_return_pct": bench_pct, "hurdle_pct": hurdle, "excess_vs_hurdle_pp": total - hurdle,
    }).drop("_last", "_days", "_bench")


def verdict(matrix: DataFrame, keys: Sequence[str] = ("market", "direction")) -> DataFrame:
    """Does the sign hold in every window? (window 0 is context only)"""
    x = F.col("excess_vs_hurdle_pp")
    g = matrix.filter(F.col("window") > 0).groupBy(*keys).agg(
        F.count_if(x > 0).alias("wins"), F.count(F.lit(1)).alias("windows"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    sign = F.when(F.col("wins") == F.col("windows"), "consistent").when(F.col("wins") == 0, "negative").otherwise("flips")
    return g.withColumns({"spread": F.col("hi") - F.col("lo"), "sign": sign})
