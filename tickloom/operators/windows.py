"""Out-of-sample windows: fresh accounts from any number of start bars over one table of legs.

Every leg knows the leg that is taken after it. Jump tables say which leg comes 1, 2, 4 ... legs later; each is the one
before joined with itself. The legs of a window are found by doubling: what is known of its path is joined with the next
jump table, so a path of n legs takes about log2(n) joins, whatever the number of windows, and no bar is walked. Legs are
made only for bars that a window can reach, so the table grows with the windows and not with the history before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.asof import asof_backward
from tickloom.operators.metrics import curve_summary
from tickloom.operators.outcomes import FLAT, NEVER, ROLL_LONG, ROLL_SHORT, Rules, account, equity_curve, legs, trades
from tickloom.session import durable


def window_ordinals(numbered: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("symbol",), by: Sequence[str] = ("window_id",)) -> DataFrame:
    """``first``/``last`` ordinal of every window and key that has a bar in it; also the buy-and-hold return over these bars."""
    inside = numbered.join(bounds.select(*by, *keys, "lo", "hi"), list(keys)).filter(F.col("ms").between(F.col("lo"), F.col("hi")))
    held = (F.max_by("close", "i") / F.min_by("close", "i") - 1.0) * 100.0
    return inside.groupBy(*by, *keys).agg(F.min("i").alias("first"), F.max("i").alias("last"), held.alias("buy_hold_pct"))


def window_bars(numbered: DataFrame, spans: DataFrame, ahead: int = 0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars from a key's first window to its last one and ``ahead`` bars after it; a key without a window has none."""
    reached = spans.groupBy(*keys).agg(F.min("first").alias("_first"), F.max("last").alias("_last"))
    near = numbered.join(reached, list(keys)).filter(F.col("i").between(F.col("_first"), F.col("_last") + ahead))
    return near.drop("_first", "_last")


def next_signal(wanted: DataFrame, signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``wanted`` (keys, x) with the first signal's ordinal ``at_i`` at or after ``x``; NULL when there is none."""
    left = wanted.withColumn("_at", -F.col("x"))
    right = signals.select(*keys, (-F.col("i")).alias("_at"), F.col("i").alias("at_i"))
    return asof_backward(left, right, keys, ["at_i"], order="_at", grid_ms=1).drop("_at")


def _leg_rows(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per leg: ``code`` = ordinal * 4 + kind and the state ``then`` it ends in."""
    def leg(kind: int, may: Column, then: str) -> Column:
        return F.when(may, F.struct((F.col("i") * 4 + kind).alias("code"), F.col(then).alias("then")))

    every = F.array(leg(FLAT, F.col("side") != 0, "e_next"), leg(ROLL_LONG, F.col("l_ok"), "l_next"), leg(ROLL_SHORT, F.col("s_ok"), "s_next"))
    return nodes.select(*keys, F.explode(F.filter(every, lambda x: x.isNotNull())).alias("_l")).select(*keys, "_l.*")


def window_legs(nodes: DataFrame, spans: DataFrame, keys: Sequence[str] = ("symbol",), by: Sequence[str] = ("window_id",)) -> DataFrame:
    """The legs (``i``, ``kind``) that one position per window and key takes from a flat start at ``first``.

    An entry needs a later bar within the window; a roll may happen on the last one.
    """
    keys, by = list(keys), list(by)
    rows = durable(_leg_rows(nodes, keys))
    flat = F.col("then").bitwiseAND(F.lit(3)) == FLAT
    ends = rows.filter(flat & (F.col("then") < NEVER)).select(*keys, F.shiftright("then", 2).alias("x"))
    wanted = ends.unionByName(spans.select(*keys, F.col("first").alias("x"))).distinct()
    found = durable(next_signal(wanted, nodes.filter("side <> 0").select(*keys, "i"), keys))
    onward = rows.withColumn("x", F.when(flat, F.shiftright("then", 2))).join(found, [*keys, "x"], "left")
    jump = durable(onward.select(*keys, "code", F.when(flat, F.col("at_i") * 4).otherwise(F.col("then")).alias("to")).filter("to is not null"))

    def valid(frame: DataFrame) -> DataFrame:
        at = F.shiftright("code", 2)
        return frame.filter((at < F.col("last")) | ((at == F.col("last")) & (F.col("code").bitwiseAND(F.lit(3)) != FLAT)))

    starts = spans.withColumn("x", F.col("first")).join(found, [*keys, "x"]).filter("at_i is not null")
    moved = durable(valid(starts.select(*by, *keys, "last", (F.col("at_i") * 4).alias("code"))))
    path = None
    while not moved.isEmpty():
        path = moved if path is None else path.unionByName(moved)
        # one join moves the windows' legs and the table's own on; dealt first, so that parts do not add up over the rounds
        known = path.withColumnRenamed("code", "to").unionByName(jump.withColumnRenamed("code", "_from"), allowMissingColumns=True)
        far = jump.select(*keys, F.col("code").alias("to"), F.col("to").alias("_far"))
        both = durable(known.repartition(*keys, "to").join(far, [*keys, "to"]).drop("to"))
        moved = valid(both.filter("_from is null").select(*by, *keys, "last", F.col("_far").alias("code")))
        jump = both.filter("_from is not null").select(*keys, F.col("_from").alias("code"), F.col("_far").alias("to"))
    path = moved if path is None else path
    return path.select(*by, *keys, "last", F.shiftright("code", 2).alias("i"), F.col("code").bitwiseAND(F.lit(3)).cast("int").alias("kind"))


def window_trades(scored: DataFrame, spans: DataFrame, rules: Rules, keys: Sequence[str] = ("symbol",), by: Sequence[str] = ("window_id",)) -> DataFrame:
    """Booked trades of every window and key, each from a fresh account; ``exit_reason`` is NULL for a position that is
    open at the window's end."""
    keys, by = list(keys), list(by)
    nodes = durable(legs(window_bars(scored, spans, rules.reach, keys), rules, keys))
    taken = nodes.join(window_legs(nodes, spans, keys, by), [*keys, "i"])
    cut = {}
    for leg in ("e", "l", "s"):
        over = F.col("i") + F.col(f"{leg}_step") > F.col("last")
        cut |= {f"{leg}_{c}": F.when(~over, F.col(f"{leg}_{c}")) for c in ("reason", "price", "ms", "step")}
    cut["fill_step"] = F.when(F.col("i") + F.col("fill_step") <= F.col("last"), F.col("fill_step"))
    return account(trades(taken.withColumns(cut).drop("last"), rules, [*by, *keys]), rules, [*by, *keys])


def window_curves(numbered: DataFrame, spans: DataFrame, booked: DataFrame, rules: Rules, keys: Sequence[str] = ("symbol",), by: Sequence[str] = ("window_id",)) -> DataFrame:
    """Equity and free cash at every bar of every window and key, also without a trade."""
    bars = numbered.join(spans.select(*by, *keys, "first", "last"), list(keys)).filter(F.col("i").between(F.col("first"), F.col("last")))
    return equity_curve(bars.select(*by, *keys, "i", "ms", "close"), booked, rules, [*by, *keys])


def window_runs(spans: DataFrame, booked: DataFrame, curves: DataFrame, rules: Rules, periods: float,
                keys: Sequence[str] = ("symbol",), by: Sequence[str] = ("window_id",)) -> DataFrame:
    """One row per window: account results averaged over its keys, and its closed trades pooled.

    Per-trade figures are shares of the trade's own notional; without a trade they are 0.
    """
    both = [*by, *keys]
    per_key = curve_summary(curves, both, periods, rules.initial).join(spans.select(*both, "buy_hold_pct"), both)
    accounts = per_key.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("total_return_pct").alias("mean_return_pct"), F.count_if(F.col("total_return_pct") > 0).alias("pairs_positive"),
        F.avg("sharpe").alias("mean_sharpe"), F.avg("max_drawdown_pct").alias("mean_max_dd_pct"), F.avg("buy_hold_pct").alias("buy_hold_pct"))
    share = lambda c: (F.avg(c) * 100.0)
    ended = booked.filter(F.col("exit_reason").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), share((F.col("pnl") > 0).cast("int")).alias("win_rate_pct"), share(F.col("gross_r")).alias("avg_gross_pct"),
        share(F.col("r")).alias("avg_net_pct"), share(F.col("cost_r")).alias("avg_cost_pct"), share((F.col("side") < 0).cast("int")).alias("short_share_pct"),
        *[F.count_if(F.col("exit_reason") == why).alias(f"exits_{why}") for why in ("tp", "sl", "timeout")])
    return accounts.join(ended, list(by), "left").na.fill(0)
