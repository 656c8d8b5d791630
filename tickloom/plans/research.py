"""Scenario grids and robustness studies over evaluated trades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.permutation import permuted_sql
from tickloom.functions.scalars import break_even_pct, regime
from tickloom.operators import labels as L
from tickloom.operators import outcomes as O
from tickloom.operators import studies as S
from tickloom.operators.ml import control_scores, with_scorers
from tickloom.plans import inputs
from tickloom.plans.common import TICKS, bars_cte, hashed_sql, indicators_cte, rounded, shared
from tickloom.plans.trading import BASE, RULES, booked, chain_sql, scored_bars, signals

QUERIES: dict = {}
ORACLE: dict = {}
SPAN = 5 * 86_400_000
T0 = 1704067200000


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# scenario: take-profit, stop, threshold, slippage, fee
SCENARIOS = {
    "base": (1.5, 2.0, 0.8, 0.0002, 0.001), "cheap": (1.5, 2.0, 0.8, 0.0, 0.0002), "dear": (1.5, 2.0, 0.8, 0.001, 0.002),
    "futures": (1.5, 2.0, 0.8, 0.0002, 0.0005), "discount": (1.5, 2.0, 0.8, 0.0002, 0.00045), "free": (1.5, 2.0, 0.8, 0.0, 0.0),
    "tight": (1.0, 1.0, 0.8, 0.0002, 0.001), "near_stop": (2.0, 1.0, 0.8, 0.0002, 0.001), "wide": (2.0, 2.0, 0.8, 0.0002, 0.001),
    "loose": (1.5, 2.0, 0.7, 0.0002, 0.001), "picky": (1.5, 2.0, 0.9, 0.0002, 0.001),
}


def grid(spark, sf, scenarios=None, name="grid"):
    """Trades of every scenario, by window, in one job."""
    def build():
        names = ["scenario", "tp_mult", "sl_mult", "threshold", "slippage", "taker_fee"]
        table = spark.createDataFrame([(k, *v) for k, v in (scenarios or SCENARIOS).items()], names)
        scored = signals(spark, sf).drop("side", "p_side").crossJoin(F.broadcast(table))
        side = L.stronger_side("p_long", "p_short", F.col("threshold"))
        scored = scored.withColumn("_s", side).select("*", F.col("_s.side").alias("side"), F.col("_s.p").alias("p_side")).drop("_s")
        return tag(O.evaluate(scored, RULES, ["scenario", "symbol"]))
    return shared((spark.sparkContext.applicationId, sf, name), build)


def tag(trades):
    return trades.filter(F.col("exit_reason").isNotNull()).withColumns({
        "window": F.floor((F.col("signal_ms") - T0) / SPAN).cast("int"), "id": F.concat("symbol", F.lit("#"), F.col("entry_i").cast("string"))})


def pool(spark, sf):
    return tag(booked(spark, sf))


WIN = f"((signal_ms - {T0}) // {SPAN})::int AS win, symbol || '#' || entry_i AS id"
POOL = f"{BASE}, {chain_sql()}, pool AS (SELECT *, {WIN} FROM trades WHERE exit_reason IS NOT NULL)"
def grid_sql(scenarios) -> str:
    return "WITH grid AS (" + " UNION ALL ".join(
    f"SELECT * FROM ({BASE}, {chain_sql(thr, 12, tp, sl, slip, fee)} SELECT '{k}' AS scenario, symbol, side, prob, exit_reason, pnl, r, gross_r, cost_r, {WIN} FROM trades WHERE exit_reason IS NOT NULL)"
    for k, (tp, sl, thr, slip, fee) in scenarios.items()) + f"""),
ps AS (SELECT scenario, win, symbol, count(*) AS n, sum(pnl) / 100 AS ret, sum((pnl > 0)::int) AS won, sum(gross_r) AS g, sum(r) AS r, sum(cost_r) AS c, sum((side < 0)::int) AS sh FROM grid GROUP BY ALL),
cells AS (SELECT scenario, win, count(*) AS pairs, sum(n)::bigint AS n_trades, avg(ret) AS mean_return_pct, count(*) FILTER (ret > 0) AS pairs_positive, sum(won) / sum(n) * 100 AS win_rate_pct, sum(g) / sum(n) * 100 AS avg_gross_pct,
  sum(r) / sum(n) * 100 AS avg_net_pct, sum(c) / sum(n) * 100 AS avg_cost_pct, sum(sh) / sum(n) * 100 AS short_share_pct FROM ps GROUP BY ALL),
{TICKS}, {bars_cte('1h')}, bw AS (SELECT symbol, ((ms - {T0}) // {SPAN})::int AS win, (arg_max(close, ms) / arg_min(close, ms) - 1) * 100 AS bh FROM bars GROUP BY 1, 2 HAVING count(*) >= 2),
rg AS (SELECT win, avg(bh) AS bh, CASE WHEN avg(bh) > 5 THEN 'up' WHEN avg(bh) < -5 THEN 'down' ELSE 'flat' END AS regime FROM bw GROUP BY win), full_cells AS (SELECT cells.*, regime, bh FROM cells JOIN rg USING (win))"""


GRID = grid_sql(SCENARIOS)


def regimes(spark, sf):
    b = inputs.bars(spark, sf)
    per = b.groupBy("symbol", F.floor((F.col("ms") - T0) / SPAN).cast("int").alias("window")).agg(
        ((F.max_by("close", "ms") / F.min_by("close", "ms") - 1) * 100).alias("bh"), F.count(F.lit(1)).alias("_n"))
    return per.filter("_n >= 2").groupBy("window").agg(F.avg("bh").alias("bh")).withColumn("regime", regime("bh"))


def cells(spark, sf):
    return S.out_of_sample(grid(spark, sf), ["scenario", "window"], RULES.initial).join(regimes(spark, sf), "window")


_CELL = ("mean_return_pct", "win_rate_pct", "avg_gross_pct", "avg_net_pct", "avg_cost_pct", "short_share_pct")


@query("buy_hold_window", f"{GRID} SELECT win AS \"window\", round(bh, 6) AS bh, regime FROM rg")
def buy_hold_window(spark, sf):
    return rounded(regimes(spark, sf))


@query("scenario_cells", f"{GRID} SELECT scenario, win AS \"window\", pairs, n_trades, pairs_positive, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _CELL)} FROM cells")
def scenario_cells(spark, sf):
    return rounded(S.out_of_sample(grid(spark, sf), ["scenario", "window"], RULES.initial))


@query("cost_grid", f"{GRID} SELECT scenario, count(*) AS n_trades, round(avg(gross_r) * 100, 6) + 0.0 AS gross_pct, round(avg(r) * 100, 6) + 0.0 AS net_pct, round(avg(cost_r) * 100, 6) AS cost_pct FROM grid WHERE scenario IN ('base', 'cheap', 'dear', 'futures', 'discount', 'free') GROUP BY scenario")
def cost_grid(spark, sf):
    g = grid(spark, sf).filter(F.col("scenario").isin("base", "cheap", "dear", "futures", "discount", "free"))
    return rounded(g.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_trades"), (F.avg("gross_r") * 100).alias("gross_pct"),
                                             (F.avg("r") * 100).alias("net_pct"), (F.avg("cost_r") * 100).alias("cost_pct")))


@query("geometry_grid", f"""{GRID} SELECT scenario, round(avg((pnl > 0)::int) * 100, 6) AS win_pct, round(CASE scenario WHEN 'tight' THEN 50.0 WHEN 'wide' THEN 50.0 WHEN 'near_stop' THEN 1.0::double / 3 * 100 ELSE 2.0::double / 3.5 * 100 END, 6) AS breakeven_pct,
 round(avg((pnl > 0)::int) * 100 - CASE scenario WHEN 'tight' THEN 50.0 WHEN 'wide' THEN 50.0 WHEN 'near_stop' THEN 1.0::double / 3 * 100 ELSE 2.0::double / 3.5 * 100 END, 6) + 0.0 AS edge_pp FROM grid WHERE scenario IN ('base', 'tight', 'near_stop', 'wide') GROUP BY scenario""")
def geometry_grid(spark, sf):
    g = grid(spark, sf).filter(F.col("scenario").isin("base", "tight", "near_stop", "wide"))
    win, be = F.avg((F.col("pnl") > 0).cast("int")) * 100, F.first(break_even_pct(F.col("tp_mult"), F.col("sl_mult")))
    return rounded(g.groupBy("scenario").agg(win.alias("win_pct"), be.alias("breakeven_pct"), (win - be).alias("edge_pp")))


@query("regime_grouping", f"""{GRID} SELECT scenario, regime, round(avg(mean_return_pct), 6) + 0.0 AS mean, round(median(mean_return_pct), 6) + 0.0 AS median, round(min(mean_return_pct), 6) + 0.0 AS worst, round(max(mean_return_pct), 6) + 0.0 AS best,
 count(*) FILTER (mean_return_pct > 0) AS windows_positive, count(*) AS windows FROM full_cells GROUP BY GROUPING SETS ((scenario), (scenario, regime))""")
def regime_grouping(spark, sf):
    return rounded(S.scenario_summary(cells(spark, sf), ["scenario"]))


@query("weighted_means", f"{GRID} SELECT scenario, sum(n_trades)::bigint AS n_trades, round(sum(avg_net_pct * n_trades) / greatest(sum(n_trades), 1), 6) + 0.0 AS avg_net_pct, round(sum(win_rate_pct * n_trades) / greatest(sum(n_trades), 1), 6) AS win_rate_pct FROM cells GROUP BY scenario")
def weighted_means(spark, sf):
    return rounded(S.weighted_means(cells(spark, sf), ["scenario"], ["avg_net_pct", "win_rate_pct"]))


PAIR = "SELECT a.scenario, count(*) AS windows, round(avg(a.mean_return_pct - b.mean_return_pct), 6) + 0.0 AS mean_diff, count(*) FILTER (a.mean_return_pct > b.mean_return_pct) AS wins, avg(a.mean_return_pct - b.mean_return_pct) / nullif(stddev_samp(a.mean_return_pct - b.mean_return_pct) / sqrt(count(*)), 0) AS t FROM cells a JOIN cells b ON b.win = a.win AND b.scenario = 'base' WHERE a.scenario <> 'base'"


# The p-value by the finite sums for whole degrees of freedom.
_SUMS = """CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: pow(cos(th), 2 * k + 1) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: 2.0::double * j / (2 * j + 1))), 1))) ELSE 0 END)
  ELSE 1 - sin(th) * list_sum(list_transform(range(0, df // 2), lambda k: pow(cos(th), 2 * k) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2.0::double * j - 1) / (2 * j))), 1))) END"""
JUDGED_SQL = "{grid}, pr AS ({pair} GROUP BY a.scenario), pv AS (SELECT * EXCLUDE (t), round(t, 4) AS t, " + _SUMS + """ AS p FROM (SELECT *, windows - 1 AS df, atan(abs(t) / sqrt(windows - 1)) AS th FROM pr))
SELECT * EXCLUDE (df, th, p), round(p, 6) AS p_value, p < 0.05 AS beyond_5pct FROM pv"""


@query("paired_diff", JUDGED_SQL.format(grid=GRID, pair=PAIR))
def paired_diff(spark, sf):
    out = S.paired_difference(cells(spark, sf), "base").withColumn("t", F.round("t", 4))
    return rounded(out, skip=("t",))


@query("holdout_pairs", JUDGED_SQL.format(grid=GRID, pair=PAIR + " AND a.win % 3 <> 0"))
def holdout_pairs(spark, sf):
    c = cells(spark, sf)
    selection = c.select("window").distinct().filter(F.col("window") % 3 == 0)
    out = S.paired_difference(c.join(selection, "window", "left_anti"), "base").withColumn("t", F.round("t", 4))
    return rounded(out, skip=("t",))


THRESHOLDS = {f"at_{int(100 * thr)}": (1.5, 2.0, thr, 0.0002, 0.001) for thr in (0.7, 0.75, 0.8, 0.85, 0.9)}


@query("threshold_sweep", JUDGED_SQL.format(grid=grid_sql(THRESHOLDS), pair=PAIR.replace("'base'", "'at_80'")))
def threshold_sweep(spark, sf):
    """Fixed thresholds, each against the base one on the same windows."""
    per_window = S.out_of_sample(grid(spark, sf, THRESHOLDS, "thresholds"), ["scenario", "window"], RULES.initial)
    return rounded(S.paired_difference(per_window, "at_80").withColumn("t", F.round("t", 4)), skip=("t",))


TPS, SLS = (1.0, 1.5, 2.0), (1.0, 1.5, 2.0)
GEOMETRIES = {f"{tp}x{sl}": (tp, sl, 0.8, 0.0002, 0.001) for tp in TPS for sl in SLS}


@query("tp_sl_grid", f"""{grid_sql(GEOMETRIES)}, e AS (SELECT split_part(scenario, 'x', 1)::double AS tp_mult, split_part(scenario, 'x', 2) AS sl, avg((pnl > 0)::int) * 100 - split_part(scenario, 'x', 2)::double / (split_part(scenario, 'x', 1)::double + split_part(scenario, 'x', 2)::double) * 100 AS edge FROM grid GROUP BY scenario)
SELECT tp_mult, {', '.join(f"round(max(edge) FILTER (sl = '{sl}'), 6) + 0.0 AS sl_{str(sl).replace('.', '_')}" for sl in SLS)} FROM e GROUP BY tp_mult""")
def tp_sl_grid(spark, sf):
    """Edge over break-even of every target and stop: targets down, stops across."""
    g = grid(spark, sf, GEOMETRIES, "geometries")
    edge = F.avg((F.col("pnl") > 0).cast("int")) * 100 - F.first(break_even_pct(F.col("tp_mult"), F.col("sl_mult")))
    cells_ = g.groupBy("tp_mult", "sl_mult").agg(edge.alias("edge"))
    wide = cells_.groupBy("tp_mult").pivot("sl_mult", list(SLS)).agg(F.first("edge"))
    return rounded(wide.select("tp_mult", *[F.col(f"`{sl}`").alias(f"sl_{str(sl).replace('.', '_')}") for sl in SLS]))


@query("regime_pivot", f"{GRID} SELECT scenario, round(avg(mean_return_pct) FILTER (regime = 'up'), 6) AS up, round(avg(mean_return_pct) FILTER (regime = 'down'), 6) AS down, round(avg(mean_return_pct) FILTER (regime = 'flat'), 6) AS flat FROM full_cells GROUP BY scenario")
def regime_pivot(spark, sf):
    return rounded(cells(spark, sf).groupBy("scenario").pivot("regime", ["up", "down", "flat"]).agg(F.avg("mean_return_pct")))


# --- probability studies on the base pool ------------------------------------------------------

@query("calibration", f"""{POOL}, k AS (SELECT *, row_number() OVER (PARTITION BY win, side ORDER BY prob, id) AS rk, count(*) OVER (PARTITION BY win, side) AS n FROM pool),
b AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ((rk - 1) * 5 + n - 2) // (n - 1)) END::int AS bucket FROM k)
SELECT bucket, round(min(prob), 6) AS p_from, round(max(prob), 6) AS p_to, count(*) AS n, round(avg((pnl > 0)::int) * 100, 6) AS win_pct, round(avg((pnl > 0)::int) * 100 - 57.142857, 6) + 0.0 AS edge_pp, round(avg(gross_r) * 100, 6) + 0.0 AS gross_pct,
 round(avg(r) * 100, 6) + 0.0 AS net_pct, round(avg(cost_r) * 100, 6) AS cost_pct, round(avg((exit_reason = 'timeout')::int) * 100, 6) AS timeout_pct FROM b GROUP BY bucket""")
def calibration(spark, sf):
    return rounded(S.calibration(pool(spark, sf), 5, 57.142857))


RANKED = f"""{POOL}, rk AS (SELECT *, (rank() OVER (PARTITION BY win ORDER BY prob) + (count(*) OVER (PARTITION BY win, prob) - 1) / 2.0::double) / count(*) OVER (PARTITION BY win) AS u, max(prob) OVER (PARTITION BY win) AS hi FROM pool),
m0 AS (SELECT *, 1 + 0.75::double * (2 * u - 1) AS a, 1 + 0.75::double * (2 * CASE WHEN hi > 0.8 THEN (prob - 0.8::double) / nullif(hi - 0.8::double, 0) ELSE 0.5 END - 1) AS b FROM rk),
m1 AS (SELECT *, a / avg(a) OVER (PARTITION BY win) AS mr, b / avg(b) OVER (PARTITION BY win) AS mp FROM m0)"""


@query("size_multipliers", f"{RANKED} SELECT id, win AS \"window\", round(u, 6) AS u, round(mr, 6) AS by_rank, round(mp, 6) AS by_p FROM m1")
def size_multipliers(spark, sf):
    t = S.rank_pct(pool(spark, sf), ["window"])
    t = S.multipliers(S.multipliers(t, 0.75, "rank", 0.8, out="by_rank"), 0.75, "p", 0.8, out="by_p")
    return rounded(t.select("id", "window", "u", "by_rank", "by_p"))


@query("sizing_gain", f"""{RANKED}, st(s) AS (VALUES (0.25::double), (0.5::double), (0.75::double)),
n0 AS (SELECT rk.*, s, 1 + s * (2 * u - 1) AS a, 1 + s * (2 * CASE WHEN hi > 0.8 THEN (prob - 0.8::double) / nullif(hi - 0.8::double, 0) ELSE 0.5 END - 1) AS b FROM rk, st),
n1 AS (SELECT *, a / avg(a) OVER (PARTITION BY s, win) AS nr, b / avg(b) OVER (PARTITION BY s, win) AS np FROM n0),
g AS (SELECT s, 'rank' AS ramp, win, sum((nr - 1) * r) * 10 AS pp FROM n1 GROUP BY s, win UNION ALL SELECT s, 'p', win, sum((np - 1) * r) * 10 FROM n1 GROUP BY s, win)
SELECT s AS strength, ramp, round(avg(pp), 6) AS avg_pp, round(median(pp), 6) AS median_pp, count(*) FILTER (pp > 0) AS windows_positive, count(*) AS windows FROM g GROUP BY s, ramp""")
def sizing_gain(spark, sf):
    ranked = S.rank_pct(pool(spark, sf), ["window"]).drop("u")
    gains = [S.sizing_gain(S.multipliers(ranked, s, kind, 0.8), 0.1).withColumns({"strength": F.lit(s), "ramp": F.lit(kind)})
             for s in (0.25, 0.5, 0.75) for kind in ("rank", "p")]
    return rounded(S.gain_table(reduce(DataFrame.unionByName, gains), ["strength", "ramp"]))


DRAWS = 200


@query("permutation_null", f"""{RANKED}, fx AS MATERIALIZED (SELECT win, mp, r, row_number() OVER (PARTITION BY win ORDER BY signal_ms, id) - 1 AS k, count(*) OVER (PARTITION BY win) AS n FROM m1),
ds AS (SELECT win, draw, r, k AS x, n, draw::bigint * 1000003 + win AS key FROM fx, range(1, {DRAWS + 1}) t(draw)), wk AS ({permuted_sql('ds', 'win, draw, r')}),
pd AS (SELECT draw, avg(pp) AS pp FROM (SELECT draw, win, sum((mp - 1) * wk.r) * 10 AS pp FROM wk JOIN fx USING (win) WHERE v = k AND v < wk.n GROUP BY 1, 2) GROUP BY draw), re AS (SELECT avg(pp) AS real_pp FROM (SELECT sum((mp - 1) * r) * 10 AS pp FROM m1 GROUP BY win))
SELECT round(real_pp, 6) AS real_pp, round(avg(pp), 6) AS null_mean_pp, round(stddev_samp(pp), 6) AS null_sd_pp, avg((pp < real_pp)::int) * 100 AS percentile, round((real_pp - avg(pp)) / stddev_samp(pp), 6) AS z, count(*) AS draws FROM pd, re GROUP BY re.real_pp""")
def permutation_null(spark, sf):
    sized = S.multipliers(pool(spark, sf), 0.75, "p", 0.8)
    null = S.permutation_gains(sized, DRAWS, 0.1)
    return rounded(S.against_null(S.sizing_gain(sized, 0.1), null))


def _ranks(where: str) -> str:
    return f"""SELECT *, (rank() OVER (PARTITION BY win ORDER BY prob) + (count(*) OVER (PARTITION BY win, prob) - 1) / 2.0::double) / count(*) OVER (PARTITION BY win) AS u,
  max(prob) OVER (PARTITION BY win) AS hi FROM pool WHERE {where}"""


SEEDS = 6


def control_trades(spark, sf):
    """Trades of the same book under scorers that know nothing, one per seed, in one job."""
    def build():
        bars = shared((spark.sparkContext.applicationId, sf, "scored"), lambda: scored_bars(spark, sf))
        rows = with_scorers(bars, {str(k): control_scores("random", 1000 * k) for k in range(1, SEEDS + 1)}).withColumnRenamed("scorer", "seed")
        rows = rows.withColumn("_s", L.stronger_side("p_long", "p_short", RULES.threshold)).select("*", F.col("_s.side").alias("side"), F.col("_s.p").alias("p_side")).drop("_s")
        return tag(O.evaluate(rows, RULES, ["seed", "symbol"]))
    return shared((spark.sparkContext.applicationId, sf, "controls"), build)


def _control_sql(seed: int) -> str:
    p_long, p_short = (hashed_sql(f"'{salt}'", f"'{seed}'", "symbol", "ms") for salt in ("long", "short"))
    return f"SELECT * FROM ({indicators_cte('1h')}, scored AS (SELECT ind.*, {p_long} AS p_long, {p_short} AS p_short FROM ind), {chain_sql()} SELECT {seed} AS seed, prob, r, {WIN} FROM trades WHERE exit_reason IS NOT NULL)"


_SHAPE = "CASE WHEN hi > 0.8 THEN (prob - 0.8::double) / nullif(hi - 0.8::double, 0) ELSE 0.5 END"


@query("control_null", f"""WITH pool AS MATERIALIZED (SELECT * FROM ({POOL} SELECT win, prob, r FROM pool)), rl AS ({_ranks('true')}),
lm AS (SELECT win, u, r, b / avg(b) OVER (PARTITION BY win) AS mult FROM (SELECT *, 1 + 0.75::double * (2 * {_SHAPE} - 1) AS b FROM rl)),
ref AS (SELECT u AS x, min(mult) AS y_first, max(mult) AS y_last FROM lm GROUP BY u), cp AS MATERIALIZED ({' UNION ALL '.join(_control_sql(1000 * k) for k in range(1, SEEDS + 1))}),
cr AS (SELECT *, (rank() OVER (PARTITION BY seed, win ORDER BY prob) + (count(*) OVER (PARTITION BY seed, win, prob) - 1) / 2.0::double) / count(*) OVER (PARTITION BY seed, win) AS u FROM cp),
lo AS (SELECT cr.*, q.x AS lx, q.y_last AS ly FROM cr ASOF LEFT JOIN ref q ON cr.u >= q.x), pl AS (SELECT lo.*, q.x AS hx, q.y_first AS hy FROM lo ASOF LEFT JOIN ref q ON lo.u <= q.x),
y AS (SELECT seed, win, r, CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL OR lx = u THEN ly ELSE ly + (hy - ly) * (u - lx) / (hx - lx) END AS raw FROM pl),
m AS (SELECT seed, win, r, raw / avg(raw) OVER (PARTITION BY seed, win) AS mult FROM y),
pd AS (SELECT seed, avg(pp) AS pp FROM (SELECT seed, win, sum((mult - 1) * r) * 10 AS pp FROM m GROUP BY 1, 2) GROUP BY seed), re AS (SELECT avg(pp) AS real_pp FROM (SELECT sum((mult - 1) * r) * 10 AS pp FROM lm GROUP BY win))
SELECT round(real_pp, 6) AS real_pp, round(avg(pp), 6) AS null_mean_pp, round(stddev_samp(pp), 6) AS null_sd_pp, avg((pp < real_pp)::int) * 100 AS percentile, round((real_pp - avg(pp)) / stddev_samp(pp), 6) AS z, count(*) AS draws FROM pd, re GROUP BY re.real_pp""")
def control_null(spark, sf):
    """The gain of sizing by probability against the same book on scorers that know nothing, with the same distribution of multipliers."""
    sized = S.multipliers(S.rank_pct(pool(spark, sf), ["window"]), 0.75, "p", 0.8)
    pinned = S.matched_multipliers(control_trades(spark, sf), sized, ["seed", "window"])
    null = S.sizing_gain(pinned, 0.1, ["seed", "window"]).groupBy("seed").agg(F.avg("pp").alias("pp"))
    return rounded(S.against_null(S.sizing_gain(sized, 0.1), null))


@query("threshold_cut", f"""{POOL}, q AS (SELECT win, unnest([1, 2, 3, 4]) AS q, unnest(quantile_cont(prob, [0.2, 0.4, 0.6, 0.8])) AS cut FROM pool GROUP BY win),
pw AS (SELECT q, win, any_value(cut) AS cut, count(*) FILTER (prob < cut) AS dropped, -10 * coalesce(sum(r) FILTER (prob < cut), 0) AS pp, -10 * (count(*) FILTER (prob < cut)) / count(*) * sum(r) AS rpp FROM pool JOIN q USING (win) GROUP BY 1, 2)
SELECT q::int AS q, round(avg(cut), 6) AS avg_cut, sum(dropped)::bigint AS dropped, round(avg(pp), 6) + 0.0 AS avg_pp, round(avg(rpp), 6) + 0.0 AS random_pp, round(avg(pp - rpp), 6) + 0.0 AS excess_pp, count(*) FILTER (pp - rpp > 0) AS windows_positive, count(*) AS windows FROM pw GROUP BY q""")
def threshold_cut(spark, sf):
    return rounded(S.weakest_cut(pool(spark, sf), 5, 0.1))


@query("pinned_multipliers", f"""{POOL}, lg AS ({_ranks('side > 0')}),
lm AS (SELECT u, b / avg(b) OVER (PARTITION BY win) AS mult FROM (SELECT *, 1 + 0.75::double * (2 * CASE WHEN hi > 0.8 THEN (prob - 0.8::double) / nullif(hi - 0.8::double, 0) ELSE 0.5 END - 1) AS b FROM lg)),
ref AS (SELECT u AS x, min(mult) AS y_first, max(mult) AS y_last FROM lm GROUP BY u), sh AS ({_ranks('side < 0')}),
lo AS (SELECT id, win, u, r.x AS lx, r.y_last AS ly FROM sh ASOF LEFT JOIN ref r ON sh.u >= r.x), pl AS (SELECT lo.*, r.x AS hx, r.y_first AS hy FROM lo ASOF LEFT JOIN ref r ON lo.u <= r.x),
y AS (SELECT id, win, u, CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL OR lx = u THEN ly ELSE ly + (hy - ly) * (u - lx) / (hx - lx) END AS raw FROM pl)
SELECT id, win AS "window", round(u, 6) AS u, round(raw / avg(raw) OVER (PARTITION BY win), 6) AS mult FROM y""")
def pinned_multipliers(spark, sf):
    p = pool(spark, sf)
    shape = S.multipliers(S.rank_pct(p.filter("side > 0"), ["window"]), 0.75, "p", 0.8)
    return rounded(S.matched_multipliers(p.filter("side < 0"), shape).select("id", "window", "u", "mult"))


@query("promotion_gate", f"""{GRID}, m AS (SELECT scenario AS name, avg(mean_return_pct) AS ret FROM cells GROUP BY 1), rv AS (SELECT name, ret FROM m WHERE name <> 'cheap' UNION ALL SELECT 'do_nothing', 0), b AS (SELECT * FROM rv ORDER BY ret DESC, name = 'do_nothing' DESC LIMIT 1)
SELECT round(m.ret, 6) AS candidate_ret, b.name AS best_rival, round(b.ret, 6) AS rival_ret, CASE WHEN m.ret < -2 THEN 'catastrophic' WHEN m.ret <= b.ret THEN 'not_better' ELSE 'promote' END AS verdict FROM m, b WHERE m.name = 'cheap'""")
def promotion_gate(spark, sf):
    means = cells(spark, sf).groupBy(F.col("scenario").alias("name")).agg(F.avg("mean_return_pct").alias("ret"))
    return rounded(S.promotion_gate(means, "cheap"))
