"""Out-of-sample windows: fresh accounts per window and symbol, and what they come to."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.timeframes import periods_per_year, to_ts
from tickloom.operators import labels as L
from tickloom.operators import ml
from tickloom.operators import studies as S
from tickloom.operators import windows as OW
from tickloom.operators.chunking import number_on_grid
from tickloom.plans import inputs
from tickloom.plans.common import hashed_sql, indicators_cte, rounded, shared, to_ts_sql
from tickloom.plans.trading import BASE, DAY, H1, RULES, leg_sql, scored_bars, signals
from tickloom.session import durable

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# window, days between its end and the newest bar, days it lasts; windows may overlap
WINDOWS = [(0, 0, 5), (1, 5, 5), (2, 10, 5), (3, 3, 14), (4, 0, 20), (5, 24, 5)]

def oos_sql(windows, p_long: str | None = None, p_short: str | None = None) -> str:
    """CTEs up to ``wt``, the booked trades of every window; the scores may be replaced."""
    base = BASE if p_long is None else f"{indicators_cte('1h')}, scored AS (SELECT ind.*, {p_long} AS p_long, {p_short} AS p_short FROM ind)"
    return f"""{base}, {leg_sql()}, wn(window_id, days_back, window_days) AS (VALUES {', '.join(str(w) for w in windows)}),
bo AS (SELECT symbol, window_id, mx - days_back::bigint * {DAY} AS hi, mx - (days_back + window_days)::bigint * {DAY} AS lo FROM (SELECT symbol, max(ms) AS mx FROM sig GROUP BY 1), wn),
sp AS MATERIALIZED (SELECT window_id, symbol, min(i) AS first_i, max(i) AS last_w, (arg_max(close, i) / arg_min(close, i) - 1) * 100 AS bh FROM sig JOIN bo USING (symbol) WHERE ms BETWEEN lo AND hi GROUP BY 1, 2),
nx AS MATERIALIZED (SELECT symbol, i AS at_i, (SELECT min(s.i) FROM ep s WHERE s.symbol = a.symbol AND s.i >= a.i) AS sig_i FROM sig a),
ch AS (SELECT sp.window_id, sp.symbol, sp.last_w, e.i AS entry_i, e.side, e.end_i, e.reason, e.price, 0 AS rolls FROM sp JOIN nx ON nx.symbol = sp.symbol AND nx.at_i = sp.first_i
    JOIN ep e ON e.symbol = sp.symbol AND e.i = nx.sig_i AND e.i < sp.last_w
  UNION ALL
  SELECT c.window_id, c.symbol, c.last_w, CASE WHEN r.i IS NOT NULL THEN c.entry_i ELSE e.i END, CASE WHEN r.i IS NOT NULL THEN c.side ELSE e.side END, CASE WHEN r.i IS NOT NULL THEN r.end_i ELSE e.end_i END,
    CASE WHEN r.i IS NOT NULL THEN r.reason ELSE e.reason END, CASE WHEN r.i IS NOT NULL THEN r.price ELSE e.price END, CASE WHEN r.i IS NOT NULL THEN c.rolls + 1 ELSE 0 END
  FROM ch c LEFT JOIN rp r ON c.reason = 'timeout' AND r.symbol = c.symbol AND r.i = c.end_i AND r.side = c.side
  LEFT JOIN nx ON r.i IS NULL AND nx.symbol = c.symbol AND nx.at_i = c.end_i LEFT JOIN ep e ON e.symbol = c.symbol AND e.i = nx.sig_i AND e.i < c.last_w
  WHERE c.end_i <= c.last_w AND (r.i IS NOT NULL OR e.i IS NOT NULL)),
tr0 AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY window_id, symbol, entry_i ORDER BY rolls DESC) = 1),
tr1 AS (SELECT t.window_id, t.symbol, t.entry_i, t.side, e.p_side AS prob, s.ms AS signal_ms, e.nopen, e.fill AS entry_price, t.rolls, CASE WHEN t.end_i <= t.last_w THEN t.end_i END AS exit_i,
  CASE WHEN t.end_i <= t.last_w THEN t.reason END AS exit_reason, CASE WHEN t.end_i <= t.last_w THEN x.ms END AS exit_ms,
  CASE WHEN t.end_i <= t.last_w THEN CASE WHEN t.side < 0 THEN t.price * 1.0002::double ELSE t.price * 0.9998::double END END AS exit_price
  FROM tr0 t JOIN ep e ON e.symbol = t.symbol AND e.i = t.entry_i JOIN sig s ON s.symbol = t.symbol AND s.i = t.entry_i LEFT JOIN sig x ON x.symbol = t.symbol AND x.i = t.end_i),
tr2 AS (SELECT *, side * (exit_price - entry_price) AS ug, 0.001::double * (entry_price + exit_price) AS uf, row_number() OVER (PARTITION BY window_id, symbol ORDER BY entry_i) AS k FROM tr1),
tr3 AS (SELECT *, coalesce(1 + 0.1::double / nopen * (ug - uf), 1) AS f FROM tr2),
tr4 AS (SELECT *, 10000.0::double * product(f) OVER (PARTITION BY window_id, symbol ORDER BY k) / f AS cash_before FROM tr3),
wt AS MATERIALIZED (SELECT *, cash_before * 0.1::double / nopen AS qty, cash_before * 0.1::double / nopen * (ug - uf) AS pnl, cash_before * f AS cash_after, (ug - uf) / entry_price AS r, ug / entry_price AS gross_r, uf / entry_price AS cost_r FROM tr4)"""


# Equity at every bar of every window, then one row per window and symbol.
PER_PAIR = """eq AS (SELECT b.window_id, b.symbol, b.i, CASE WHEN t.entry_i IS NULL THEN 10000.0::double WHEN t.exit_i IS NULL OR b.i < t.exit_i
    THEN t.cash_before - t.qty * t.entry_price * 0.001::double + t.side * t.qty * (b.close - t.entry_price) ELSE t.cash_after END AS equity
  FROM (SELECT window_id, sig.symbol, i, close FROM sig JOIN sp ON sp.symbol = sig.symbol AND i BETWEEN first_i AND last_w) b
  ASOF LEFT JOIN wt t ON t.window_id = b.window_id AND t.symbol = b.symbol AND b.i >= t.entry_i),
cv AS (SELECT *, equity / lag(equity) OVER s - 1 AS ret, equity / max(equity) OVER s - 1 AS dd FROM eq WINDOW s AS (PARTITION BY window_id, symbol ORDER BY i)),
pk AS (SELECT window_id, symbol, (arg_max(equity, i) / 10000 - 1) * 100 AS total, min(dd) * 100 AS mdd, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(8760.0), 0) AS sharpe FROM cv GROUP BY 1, 2)"""
OOS = oos_sql(WINDOWS)


def spans(spark, sf):
    bars = number_on_grid(inputs.bars(spark, sf), ["symbol"], H1)
    table = spark.createDataFrame(WINDOWS, "window_id int, days_back int, window_days int")
    return bars, shared((spark.sparkContext.applicationId, sf, "oos_spans"), lambda: OW.window_ordinals(bars, ml.window_bounds(bars, table)))


def oos_booked(spark, sf):
    _, found = spans(spark, sf)
    return shared((spark.sparkContext.applicationId, sf, "oos_trades"), lambda: OW.window_trades(signals(spark, sf), found, RULES))


@query("oos_trades", f"""{OOS} SELECT window_id, symbol, {to_ts_sql('signal_ms')} AS signal_at, {to_ts_sql('exit_ms')} AS exit_at, side::int AS side, exit_reason, rolls::bigint AS rollovers,
  round(prob, 6) AS prob, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(qty, 6) AS qty, round(pnl, 6) + 0.0 AS pnl FROM wt""")
def oos_trades(spark, sf):
    t = oos_booked(spark, sf)
    return rounded(t.select("window_id", "symbol", to_ts("signal_ms").alias("signal_at"), to_ts("exit_ms").alias("exit_at"), F.col("side").cast("int").alias("side"),
                            "exit_reason", "rollovers", "prob", "entry_price", "exit_price", "qty", "pnl"))


@query("oos_runs", f"""{OOS}, {PER_PAIR},
ac AS (SELECT window_id, count(*) AS pairs, avg(total) AS mean_return_pct, count(*) FILTER (total > 0) AS pairs_positive, avg(sharpe) AS mean_sharpe, avg(mdd) AS mean_max_dd_pct, avg(bh) AS buy_hold_pct FROM pk JOIN sp USING (window_id, symbol) GROUP BY 1),
en2 AS (SELECT window_id, count(*) AS n_trades, avg((pnl > 0)::int) * 100 AS win, avg(gross_r) * 100 AS g, avg(r) * 100 AS r, avg(cost_r) * 100 AS c, avg((side < 0)::int) * 100 AS sh, count(*) FILTER (exit_reason = 'tp') AS tp,
  count(*) FILTER (exit_reason = 'sl') AS sl, count(*) FILTER (exit_reason = 'timeout') AS tm FROM wt WHERE exit_reason IS NOT NULL GROUP BY 1)
SELECT window_id, pairs, round(mean_return_pct, 6) + 0.0 AS mean_return_pct, pairs_positive, round(mean_sharpe, 6) + 0.0 AS mean_sharpe, round(mean_max_dd_pct, 6) + 0.0 AS mean_max_dd_pct, round(buy_hold_pct, 6) AS buy_hold_pct,
  coalesce(n_trades, 0) AS n_trades, round(coalesce(win, 0), 6) AS win_rate_pct, round(coalesce(g, 0), 6) + 0.0 AS avg_gross_pct, round(coalesce(r, 0), 6) + 0.0 AS avg_net_pct, round(coalesce(c, 0), 6) AS avg_cost_pct,
  round(coalesce(sh, 0), 6) AS short_share_pct, coalesce(tp, 0) AS exits_tp, coalesce(sl, 0) AS exits_sl, coalesce(tm, 0) AS exits_timeout FROM ac LEFT JOIN en2 USING (window_id)""")
def oos_runs(spark, sf):
    bars, found = spans(spark, sf)
    booked = oos_booked(spark, sf)
    curves = OW.window_curves(bars, found, booked, RULES)
    return rounded(OW.window_runs(found, booked, curves, RULES, periods_per_year("1h")))


# --- a candidate against scorers that know nothing, on the same held-out bars -------------------

HOLDOUT = [(0, 0, 12)]
CONTROLS = ("always_long", "always_short", "random")
SCORERS = {
    "candidate": (hashed_sql("'L'", "symbol", "ms"), hashed_sql("'S'", "symbol", "ms")), "always_long": ("1.0::double", "0.0::double"),
    "always_short": ("0.0::double", "1.0::double"), "random": (hashed_sql("'long'", "'7'", "symbol", "ms"), hashed_sql("'short'", "'7'", "symbol", "ms")),
}


def held_out(spark, sf):
    """One row per scorer: mean return over the symbols, trades; every scorer sees the same bars and costs."""
    def build():
        # numbered already: windows, signals and curves all come from these bars, so the ticks are read once
        scored = shared((spark.sparkContext.applicationId, sf, "scored"), lambda: scored_bars(spark, sf))
        bounds = ml.window_bounds(scored, spark.createDataFrame(HOLDOUT, "window_id int, days_back int, window_days int"))
        windows = durable(OW.window_ordinals(scored, bounds))
        bars = durable(OW.window_bars(scored, windows, RULES.reach).repartition("symbol", "i"))
        scores = {"candidate": (F.col("p_long"), F.col("p_short"))} | {kind: ml.control_scores(kind, 7) for kind in CONTROLS}
        rows = ml.with_scorers(bars, scores)
        rows = rows.withColumn("_s", L.stronger_side("p_long", "p_short", RULES.threshold)).select("*", F.col("_s.side").alias("side"), F.col("_s.p").alias("p_side")).drop("_s")
        found = windows.withColumn("scorer", F.explode(F.array(*[F.lit(name) for name in scores])))
        keys = ("scorer", "symbol")
        booked = durable(OW.window_trades(rows, found, RULES, keys))
        curves = OW.window_curves(rows.select("scorer", "symbol", "i", "ms", "close"), found, booked, RULES, keys)
        return OW.window_runs(found, booked, curves, RULES, periods_per_year("1h"), ("symbol",), ("scorer", "window_id"))
    return shared((spark.sparkContext.applicationId, sf, "held_out"), build)


SCORED_SQL = " UNION ALL ".join(
    f"""SELECT * FROM ({oos_sql(HOLDOUT, *scores)}, {PER_PAIR} SELECT '{name}' AS scorer, avg(total) AS ret, avg(sharpe) AS sharpe, avg(mdd) AS mdd, avg(bh) AS bh, (SELECT count(*) FROM wt WHERE exit_reason IS NOT NULL) AS n_trades
  FROM pk JOIN sp USING (window_id, symbol))""" for name, scores in SCORERS.items())


@query("holdout_scorers", f"""SELECT scorer, round(ret, 6) + 0.0 AS mean_return_pct, round(sharpe, 6) + 0.0 AS mean_sharpe, round(mdd, 6) + 0.0 AS mean_max_dd_pct, round(bh, 6) AS buy_hold_pct, n_trades FROM ({SCORED_SQL})""")
def holdout_scorers(spark, sf):
    return rounded(held_out(spark, sf).select("scorer", "mean_return_pct", "mean_sharpe", "mean_max_dd_pct", "buy_hold_pct", "n_trades"))


@query("holdout_gate", f"""WITH m AS (SELECT scorer AS name, ret FROM ({SCORED_SQL})), rv AS (SELECT name, ret FROM m WHERE name <> 'candidate' UNION ALL SELECT 'do_nothing', 0), b AS (SELECT * FROM rv ORDER BY ret DESC, name = 'do_nothing' DESC LIMIT 1)
SELECT round(m.ret, 6) AS candidate_ret, b.name AS best_rival, round(b.ret, 6) AS rival_ret, CASE WHEN m.ret < -2 THEN 'catastrophic' WHEN m.ret <= b.ret THEN 'not_better' ELSE 'promote' END AS verdict FROM m, b WHERE m.name = 'candidate'""")
def holdout_gate(spark, sf):
    return rounded(S.promotion_gate(held_out(spark, sf).select(F.col("scorer").alias("name"), F.col("mean_return_pct").alias("ret")), "candidate"))
