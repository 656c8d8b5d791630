"""Robustness studies over tables of trades: calibration, sizing, nulls, cuts, paired comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.permutation import permuted
from tickloom.functions.statistics import t_p_value
from tickloom.operators.asof import interpolate
from tickloom.operators.chunking import distinct_ranks, exact_quantile, number_by_range, number_by_slot


def buckets(trades: DataFrame, n_buckets: int, keys: Sequence[str] = ("window", "side"), value: str = "prob", tie: str = "id") -> DataFrame:
    """Quantile bucket 1..n of each row inside its group, from the row's rank in integer arithmetic."""
    keys = list(keys)
    ranked = number_by_range(trades, keys, [value, tie])
    sizes = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked.join(sizes, keys)
    bucket = F.greatest(F.lit(1), F.ceil(F.col("i") * n_buckets / F.nullif(F.col("_n") - 1, F.lit(0)))).cast("int")
    return rows.withColumn("bucket", F.coalesce(bucket, F.lit(1))).drop("i", "_n")


def calibration(trades: DataFrame, n_buckets: int, breakeven: float) -> DataFrame:
    """Hit rate and return per probability bucket."""
    win = F.avg((F.col("pnl") > 0).cast("int")) * 100.0
    return buckets(trades, n_buckets).groupBy("bucket").agg(
        F.min("prob").alias("p_from"), F.max("prob").alias("p_to"), F.count(F.lit(1)).alias("n"), win.alias("win_pct"),
        (win - breakeven).alias("edge_pp"), (F.avg("gross_r") * 100.0).alias("gross_pct"), (F.avg("r") * 100.0).alias("net_pct"),
        (F.avg("cost_r") * 100.0).alias("cost_pct"), (F.avg((F.col("exit_reason") == "timeout").cast("int")) * 100.0).alias("timeout_pct"))


def rank_pct(trades: DataFrame, keys: Sequence[str] = ("window",), value: str = "prob", out: str = "u") -> DataFrame:
    """Average-rank percentile inside each group."""
    keys = list(keys)
    sizes = trades.groupBy(*keys).agg(F.count(value).alias("_n"))
    ranks = distinct_ranks(trades, keys, value).join(sizes, keys)
    ranks = ranks.select(*keys, value, ((F.col("_below") + (F.col("_peers") + 1) / 2.0) / F.col("_n")).alias(out))
    return trades.join(ranks, [*keys, value])


def _unit_mean(rows: DataFrame, raw: Column, keys: Sequence[str], out: str) -> DataFrame:
    rows = rows.withColumn("_m", raw)
    mean = rows.groupBy(*keys).agg(F.avg("_m").alias("_mean"))
    return rows.join(mean, list(keys)).withColumn(out, F.col("_m") / F.col("_mean")).drop("_m", "_mean")


def multipliers(trades: DataFrame, strength: float, kind: str, threshold: float, keys: Sequence[str] = ("window",),
                value: str = "prob", out: str = "mult") -> DataFrame:
    """Size multipliers in [1-s, 1+s] with mean one per window, ramped in p or in its rank."""
    keys = list(keys)
    if kind == "rank":
        rows, u = rank_pct(trades, keys, value, "_u"), F.col("_u")
    else:
        top = trades.groupBy(*keys).agg(F.max(value).alias("_hi"))
        rows = trades.join(top, keys)
        u = F.when(F.col("_hi") > threshold, (F.col(value) - threshold) / F.nullif(F.col("_hi") - threshold, F.lit(0.0))).otherwise(0.5)
    done = _unit_mean(rows, 1.0 + strength * (2.0 * u - 1.0), keys, out)
    return done.drop("_u", "_hi")


def matched_multipliers(trades: DataFrame, reference: DataFrame, keys: Sequence[str] = ("window",)) -> DataFrame:
    """The reference's multiplier distribution (columns u, mult) laid over these trades' ranks."""
    placed = interpolate(rank_pct(trades, keys), reference.select("u", "mult"), "u", "u", "mult", "_raw")
    return _unit_mean(placed, F.col("_raw"), list(keys), "mult").drop("_raw")


def sizing_gain(sized: DataFrame, position_pct: float, keys: Sequence[str] = ("window",), mult: str = "mult") -> DataFrame:
    """Change of each window's return, in points, from scaling its trades."""
    return sized.groupBy(*keys).agg((F.sum((F.col(mult) - 1.0) * F.col("r")) * position_pct * 100.0).alias("pp"))


def gain_table(gains: DataFrame, keys: Sequence[str]) -> DataFrame:
    return gains.groupBy(*keys).agg(
        F.avg("pp").alias("avg_pp"), F.median("pp").alias("median_pp"), F.count_if(F.col("pp") > 0).alias("windows_positive"),
        F.count(F.lit(1)).alias("windows"))


def permutation_gains(sized: DataFrame, draws: int, position_pct: float, at: str = "signal_ms", slot_ms: int = 86_400_000) -> DataFrame:
    """Mean gain per draw when the multipliers are reshuffled among the trades of a window.

    Trades are numbered once per window, by (``at``, id). A draw takes each to the multiplier at its place in a keyed
    permutation, so it is an equi-join on that place: no copy of the trades is sorted or stored.
    """
    numbered = number_by_slot(sized.select("window", "id", at, "r", "mult"), ["window"], F.floor(F.col(at) / slot_ms).cast("long"), [at, "id"])
    sizes = sized.groupBy("window").agg(F.count(F.lit(1)).alias("_n"))
    copies = numbered.select("window", "r", "i").join(sizes, "window").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = F.col("draw").cast("long") * 1_000_003 + F.col("window")
    drawn = copies.select("draw", "window", "r", permuted(F.col("i"), F.col("_n"), key).alias("i"))
    shuffled = drawn.join(numbered.select("window", "i", "mult"), ["window", "i"])
    return sizing_gain(shuffled, position_pct, ["draw", "window"]).groupBy("draw").agg(F.avg("pp").alias("pp"))


def against_null(real: DataFrame, null: DataFrame) -> DataFrame:
    """Where the real mean gain stands among the null draws."""
    r = real.agg(F.avg("pp").alias("real_pp"))
    joined = null.crossJoin(F.broadcast(r))
    sd = F.stddev_samp("pp")
    return joined.groupBy("real_pp").agg(
        F.avg("pp").alias("null_mean_pp"), sd.alias("null_sd_pp"), (F.avg((F.col("pp") < F.col("real_pp")).cast("int")) * 100.0).alias("percentile"),
        F.coalesce((F.first("real_pp") - F.avg("pp")) / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("z"), F.count(F.lit(1)).alias("draws"))


def weakest_cut(trades: DataFrame, n_buckets: int, position_pct: float) -> DataFrame:
    """Dropping the weakest q/n of each window by probability, against dropping as many at random."""
    probs = {f"q{q}": q / n_buckets for q in range(1, n_buckets)}
    cuts = exact_quantile(trades, ["window"], "prob", probs, "id")
    levels = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{q}").alias("cut")) for q in range(1, n_buckets)]))
    rows = trades.join(cuts.select("window", levels.alias("_c")).select("window", "_c.*"), "window")
    gone = F.col("prob") < F.col("cut")
    per = rows.groupBy("q", "window").agg(
        F.first("cut").alias("cut"), F.count_if(gone).alias("dropped"), (F.sum(F.when(gone, F.col("r")).otherwise(0.0)) * -position_pct * 100.0).alias("pp"),
        (F.count_if(gone) / F.count(F.lit(1)) * F.sum("r") * -position_pct * 100.0).alias("rand_pp"))
    excess = F.col("pp") - F.col("rand_pp")
    return per.groupBy("q").agg(
        F.avg("cut").alias("avg_cut"), F.sum("dropped").alias("dropped"), F.avg("pp").alias("avg_pp"), F.avg("rand_pp").alias("random_pp"),
        F.avg(excess).alias("excess_pp"), F.count_if(excess > 0).alias("windows_positive"), F.count(F.lit(1)).alias("windows"))


def out_of_sample(trades: DataFrame, keys: Sequence[str], initial: float) -> DataFrame:
    """Trades -> symbols -> windows: mean return over symbols, per-trade gross, net and cost."""
    per_symbol = trades.groupBy(*keys, "symbol").agg(
        F.count(F.lit(1)).alias("_n"), (F.sum("pnl") / initial * 100.0).alias("_ret"), F.sum((F.col("pnl") > 0).cast("int")).alias("_won"),
        F.sum("gross_r").alias("_g"), F.sum("r").alias("_r"), F.sum("cost_r").alias("_c"), F.sum((F.col("side") < 0).cast("int")).alias("_short"))
    n = F.sum("_n")
    share = lambda c: (F.sum(c) / n * 100.0)
    return per_symbol.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), n.alias("n_trades"), F.avg("_ret").alias("mean_return_pct"), F.count_if(F.col("_ret") > 0).alias("pairs_positive"),
        share("_won").alias("win_rate_pct"), share("_g").alias("avg_gross_pct"), share("_r").alias("avg_net_pct"),
        share("_c").alias("avg_cost_pct"), share("_short").alias("short_share_pct"))


def scenario_summary(cells: DataFrame, keys: Sequence[str], by: str = "regime", value: str = "mean_return_pct") -> DataFrame:
    """Distribution over windows, overall and split (grouping sets); overall rows have a NULL split."""
    sets = [list(keys), [*keys, by]]
    x = F.col(value)
    return cells.groupingSets([[F.col(c) for c in s] for s in sets], *[*keys, by]).agg(
        F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("worst"), F.max(x).alias("best"),
        F.count_if(x > 0).alias("windows_positive"), F.count(F.lit(1)).alias("windows"))


def weighted_means(cells: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str = "n_trades") -> DataFrame:
    total = F.greatest(F.sum(weight), F.lit(1))
    return cells.groupBy(*keys).agg(F.sum(weight).alias(weight), *[(F.sum(F.col(v) * F.col(weight)) / total).alias(v) for v in values])


def paired_difference(cells: DataFrame, base: str, scenario: str = "scenario", on: Sequence[str] = ("window",), value: str = "mean_return_pct") -> DataFrame:
    """Each scenario against the base on the same windows: mean difference, wins, paired t and its two-sided p-value."""
    ref = cells.filter(F.col(scenario) == base).select(*on, F.col(value).alias("_base"))
    diff = cells.filter(F.col(scenario) != base).join(ref, list(on)).withColumn("_d", F.col(value) - F.col("_base"))
    n, sd = F.count("_d"), F.stddev_samp("_d")
    t = F.avg("_d") / F.nullif(sd / F.sqrt(n), F.lit(0.0))
    out = diff.groupBy(scenario).agg(
        n.alias("windows"), F.avg("_d").alias("mean_diff"), F.count_if(F.col("_d") > 0).alias("wins"), t.alias("t"))
    out = out.withColumn("p_value", t_p_value(F.col("t"), F.col("windows") - 1))
    return out.withColumn("beyond_5pct", F.col("p_value") < 0.05)


@cache
def t_limits(most: int = 30, level: float = 0.05) -> tuple[float, ...]:
    """Two-sided limits for 1 to ``most`` degrees of freedom, by halving."""
    out = []
    for df in range(1, most + 1):
        low, high = 0.0, 20.0
        for _ in range(30):
            mid = (low + high) / 2
            low, high = (mid, high) if t_two_sided_p(mid, df, 600) > level else (low, mid)
        out.append(round(low, 6))
    return tuple(out)


def t_two_sided_p(t: float, df: int, steps: int = 4000) -> float:
    """P-value of a t statistic by numeric integration; for the handful of numbers a report prints."""
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    hi = math.atan(abs(t) / math.sqrt(df))
    h = hi / steps
    inner = sum((4 if k % 2 else 2) * math.cos(k * h) ** (df - 1) for k in range(1, steps))
    area = (1 + inner + math.cos(hi) ** (df - 1)) * h / 3 * norm * math.sqrt(df)
    return max(0.0, 1.0 - 2.0 * area)


def promotion_gate(results: DataFrame, candidate: str, floor_pct: float = -2.0) -> DataFrame:
    """Candidate against the best of its controls and doing nothing (which wins ties)."""
    idle = results.filter(F.col("name") == candidate).select(F.lit("do_nothing").alias("name"), F.lit(0.0).alias("ret"))
    rivals = results.filter(F.col("name") != candidate).select("name", "ret").unionByName(idle)
    best = rivals.agg(F.max(F.struct("ret", (F.col("name") == "do_nothing").alias("idle"), "name")).alias("_b"))
    own = results.filter(F.col("name") == candidate).select(F.col("ret").alias("candidate_ret"))
    both = own.crossJoin(F.broadcast(best))
    verdict = F.when(F.col("candidate_ret") < floor_pct, "catastrophic").when(F.col("candidate_ret") <= F.col("_b.ret"), "not_better").otherwise("promote")
    return both.select("candidate_ret", F.col("_b.name").alias("best_rival"), F.col("_b.ret").alias("rival_ret"), verdict.alias("verdict"))
