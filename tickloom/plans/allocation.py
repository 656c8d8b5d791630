"""Panels, ranking curves, diversification screen and portfolio tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.scalars import Costs, drift_flag
from tickloom.operators import curves as C
from tickloom.operators import portfolio as P
from tickloom.operators import ranking as R
from tickloom.operators import screen as S
from tickloom.plans import inputs
from tickloom.plans.common import rounded, shared
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


P25 = """p25 AS (SELECT p_brand AS symbol, l_shipdate::date AS date, sum(round(l_extendedprice * 100)::bigint) / 100.0::double / sum(l_quantity::bigint) AS close
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
P5 = """p5 AS (SELECT o_orderpriority AS symbol, o_orderdate::date AS date, sum(round(o_totalprice * 100)::bigint) / 100.0::double / count(*) AS close FROM orders GROUP BY 1, 2)"""


def dense_sql(src: str, out: str = "d") -> str:
    return f"""{out}g AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM {src})), {out}s AS (SELECT DISTINCT symbol FROM {src}),
{out} AS (SELECT g.date, g.i, s.symbol, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY g.date) AS close FROM {out}g g CROSS JOIN {out}s s LEFT JOIN {src} b ON b.symbol = s.symbol AND b.date = g.date)"""


D25 = f"WITH RECURSIVE {P25}, {dense_sql('p25')}"
D5 = f"WITH RECURSIVE {P5}, {dense_sql('p5', 'dd')}, c5 AS (SELECT date FROM dd GROUP BY date HAVING count(close) = (SELECT count(*) FROM dds)), d0 AS (SELECT dd.* FROM dd JOIN c5 USING (date)), d AS (SELECT date, symbol, close, dense_rank() OVER (ORDER BY date) - 1 AS i FROM d0)"


def dense25(spark, sf):
    return shared((spark.sparkContext.applicationId, sf, "panel25"), lambda: C.dense_panel(inputs.panel25(spark, sf)))


def dense5(spark, sf):
    """Five-asset panel cut to the dates on which every asset has a price."""
    def build():
        full = C.complete_dates(C.dense_panel(inputs.panel5(spark, sf))).drop("i")
        return full.join(C.number_dates(full, "date"), "date")
    return shared((spark.sparkContext.applicationId, sf, "panel5"), build)


@query("panel_wide", f"{D25} SELECT date, i::bigint AS i, symbol, round(close, 6) AS close FROM d")
def panel_wide(spark, sf):
    return rounded(dense25(spark, sf).select("date", "i", "symbol", "close"))


@query("panel_breadth", f"{D25} SELECT date, count(close) AS names FROM d GROUP BY date HAVING count(close) >= 20")
def panel_breadth(spark, sf):
    return C.breadth(dense25(spark, sf), 20).groupBy("date").agg(F.count("close").alias("names"))


@query("panel_complete", f"{D5} SELECT date, symbol, round(close, 6) AS close FROM d")
def panel_complete(spark, sf):
    return rounded(dense5(spark, sf).select("date", "symbol", "close"))


LOOK, SKIP, EVERY, NL, NS, RATE = 60, 5, 20, 5, 5, 0.0012
WARM = LOOK + SKIP + 1

MOM = f"""mo AS (SELECT *, lag(close, {SKIP}) OVER s / lag(close, {SKIP + LOOK}) OVER s - 1 AS score, lag(close, {SKIP + 1}) OVER s / lag(close, {SKIP + LOOK + 1}) OVER s - 1 AS score_prev FROM d WINDOW s AS (PARTITION BY symbol ORDER BY i))"""


def rank_sql(direction: str, src: str = "mo", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    ns = NS if direction == "long_short" else 0
    return f"""ra_{direction} AS (SELECT {k}i, symbol, close, row_number() OVER (PARTITION BY {k}i ORDER BY score_prev DESC, symbol) AS rt, row_number() OVER (PARTITION BY {k}i ORDER BY score_prev, symbol DESC) AS rb, count(*) OVER (PARTITION BY {k}i) AS n
  FROM {src} WHERE score_prev IS NOT NULL AND i >= {WARM} AND (i - {WARM}) % {EVERY} = 0),
wl_{direction} AS (SELECT *, CASE WHEN rt <= {NL} THEN 1 WHEN rb <= least({ns}, n - least({NL}, n)) THEN -1 END AS leg FROM ra_{direction}),
w_{direction} AS (SELECT {k}i, symbol, close AS price, leg, leg * {'1.0' if direction == 'long_only' else '0.5'}::double / count(*) OVER (PARTITION BY {k}i, leg) AS weight FROM wl_{direction} WHERE leg IS NOT NULL)"""


def curve_sql(w: str, panel: str, rate: float, initial: float, first_row: int, out: str, ter: float = 0.0) -> str:
    """Rebalanced curve keyed by ``k`` (curve id): w(k,i,symbol,weight,price), panel(k,i,symbol,close)."""
    return f"""{out}r AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM (SELECT DISTINCT k, i FROM {w})),
{out}rows AS (SELECT DISTINCT k, i FROM {panel} WHERE i >= {first_row}),
{out}v AS (SELECT x.k, r.n, r.i AS seg, x.i, sum(w.weight) AS sw, sum(w.weight * p.close / w.price) AS net, sum(abs(w.weight * p.close / w.price)) AS gross
  FROM {out}rows x JOIN {out}r r ON r.k = x.k AND x.i >= r.i LEFT JOIN {out}r nx ON nx.k = r.k AND nx.n = r.n + 1 JOIN {w} w ON w.k = r.k AND w.i = r.i
  JOIN {panel} p ON p.k = x.k AND p.i = x.i AND p.symbol = w.symbol WHERE nx.i IS NULL OR x.i <= nx.i GROUP BY ALL),
{out}g AS (SELECT v.*, 1 - sw + net - {ter}::double * (sum(net) OVER (PARTITION BY k, n ORDER BY i) - CASE WHEN n2.ni = v.i THEN net ELSE 0 END) AS growth, n2.ni FROM {out}v v
  LEFT JOIN (SELECT k AS k2, n AS nn, lead(i) OVER (PARTITION BY k ORDER BY n) AS ni FROM {out}r) n2 ON n2.k2 = v.k AND n2.nn = v.n),
{out}old AS (SELECT g.k, g.n + 1 AS n, w.symbol, w.weight * p.close / w.price AS v FROM {out}g g JOIN {w} w ON w.k = g.k AND w.i = g.seg JOIN {panel} p ON p.k = g.k AND p.i = g.i AND p.symbol = w.symbol WHERE g.ni = g.i),
{out}new AS (SELECT r.k, r.n, w.symbol, w.weight FROM {out}r r JOIN {w} w ON w.k = r.k AND w.i = r.i),
{out}pr AS (SELECT k, n, list(struct_pack(w := coalesce(weight, 0), v := coalesce(v, 0))) AS pairs FROM {out}new FULL JOIN {out}old USING (k, n, symbol) GROUP BY k, n),
{out}st AS MATERIALIZED (SELECT pr.k, pr.n, pairs, g.growth AS gg FROM {out}pr pr LEFT JOIN {out}g g ON g.k = pr.k AND g.n = pr.n - 1 AND g.ni = g.i),
{out}c AS (SELECT k, n, 1.0::double AS e, list_sum(list_transform(pairs, lambda x: abs(x.w - x.v)))::double AS turnover FROM {out}st WHERE n = 1
  UNION ALL SELECT s.k, s.n, c.e * (s.gg - {rate}::double * c.turnover), list_sum(list_transform(s.pairs, lambda x: abs(x.w - x.v / (s.gg - {rate}::double * c.turnover)))) FROM {out}c c JOIN {out}st s ON s.k = c.k AND s.n = c.n + 1),
{out} AS (SELECT x.k, x.i, coalesce({initial}::double * c.e * (g.growth - {rate}::double * c.turnover), {initial}::double) AS equity, coalesce(g.gross / (g.growth - {rate}::double * c.turnover) * 100, 0) AS gross_pct,
  coalesce(g.net / (g.growth - {rate}::double * c.turnover) * 100, 0) AS net_pct, CASE WHEN g.seg = x.i THEN {initial}::double * c.e * c.turnover END AS traded, CASE WHEN g.seg = x.i THEN {initial}::double * c.e * c.turnover * {rate}::double END AS cost
  FROM {out}rows x LEFT JOIN {out}g g ON g.k = x.k AND g.i = x.i AND (g.ni IS NULL OR g.i < g.ni) LEFT JOIN {out}c c ON c.k = g.k AND c.n = g.n)"""


@query("momentum", f"{D25}, {MOM} SELECT date, symbol, round(score, 6) + 0.0 AS score FROM mo WHERE score IS NOT NULL")
def momentum(spark, sf):
    return rounded(R.momentum(dense25(spark, sf), LOOK, SKIP).filter(F.col("score").isNotNull()).select("date", "symbol", "score"))


@query("rank_legs", f"{D25}, {MOM}, {rank_sql('long_short')} SELECT i::bigint AS i, symbol, leg::int AS leg FROM wl_long_short WHERE leg IS NOT NULL")
def rank_legs(spark, sf):
    p = dense25(spark, sf)
    due = R.momentum(p, LOOK, SKIP, extra_lag=1).filter((F.col("i") >= WARM) & ((F.col("i") - WARM) % EVERY == 0))
    return R.select_legs(due, NL, NS).select("i", "symbol", "leg")


for _d in ("long_only", "long_short"):
    def _weights(spark, sf, d=_d):
        return rounded(R.scheduled_weights(dense25(spark, sf), LOOK, SKIP, EVERY, NL, NS, d).select("i", "symbol", "weight"))
    query(f"rank_weights_{_d}", f"{D25}, {MOM}, {rank_sql(_d)} SELECT i::bigint AS i, symbol, round(weight, 6) AS weight FROM w_{_d}")(_weights)

    def _curve(spark, sf, d=_d):
        p = dense25(spark, sf)
        w = R.scheduled_weights(p, LOOK, SKIP, EVERY, NL, NS, d)
        return rounded(R.rebalanced_curve(p, w, RATE, 10_000.0, first_row=WARM), 4)
    query(f"rank_curve_{_d}", f"""{D25}, {MOM}, {rank_sql(_d)}, kw AS (SELECT 0 AS k, * FROM w_{_d}), kp AS (SELECT 0 AS k, * FROM d), {curve_sql('kw', 'kp', RATE, 10000.0, WARM, 'cv')}
SELECT i::bigint AS i, round(equity, 4) AS equity, round(gross_pct, 4) AS gross_pct, round(net_pct, 4) + 0.0 AS net_pct, round(traded, 4) AS traded, round(cost, 4) AS cost FROM cv""")(_curve)

NWIN = 4
WINDOWED = f"""nw AS (SELECT max(i) + 1 AS n FROM d), sp AS (SELECT k AS win, (k - 1) * ((n - {WARM}) // {NWIN}) AS a, (k - 1) * ((n - {WARM}) // {NWIN}) + {WARM} + (n - {WARM}) // {NWIN} AS b FROM nw, range(1, {NWIN + 1}) t(k) UNION ALL SELECT 0, 0, n FROM nw),
wp AS (SELECT win AS k, date, symbol, close, i - a AS i FROM d JOIN sp ON i >= a AND i < b), mo AS (SELECT *, lag(close, {SKIP + 1}) OVER s / lag(close, {SKIP + LOOK + 1}) OVER s - 1 AS score_prev FROM wp WINDOW s AS (PARTITION BY k, symbol ORDER BY i))"""


def matrix_sql() -> str:
    parts = []
    for d in ("long_only", "long_short"):
        hurdle = "b" if d == "long_only" else "0"
        parts.append(f"""SELECT '{d}' AS direction, k AS win, bars, nreb, tot, cagr, sharpe, mdd, b, tot - {hurdle} AS excess, sig, ag, an, tx, fees FROM (
 SELECT k, count(*) AS bars, count(cost) AS nreb, (arg_max(equity, i) / 10000 - 1) * 100 AS tot, (power(arg_max(equity, i) / 10000, 1.0 / greatest(date_diff('day', min(date), max(date)) / 365.25::double, 1e-9)) - 1) * 100 AS cagr,
  coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365.0), 0) AS sharpe, min(dd) * 100 AS mdd, coalesce(avg(ret) / (nullif(stddev_samp(ret), 0) / sqrt(count(ret))), 0) AS sig, avg(gross_pct) AS ag, avg(net_pct) AS an, coalesce(sum(traded), 0) / 10000 AS tx, coalesce(sum(cost), 0) AS fees
 FROM (SELECT c.*, q.date, equity / lag(equity) OVER s - 1 AS ret, equity / max(equity) OVER s - 1 AS dd FROM cv_{d} c JOIN (SELECT DISTINCT k, i, date FROM wp) q USING (k, i) WINDOW s AS (PARTITION BY c.k ORDER BY c.i)) GROUP BY k) JOIN bench USING (k)""")
    return f"""{D25}, {WINDOWED}, {rank_sql('long_only', keys='k')}, {rank_sql('long_short', keys='k')}, {curve_sql('w_long_only', 'wp', RATE, 10000.0, WARM, 'cv_long_only')}, {curve_sql('w_long_short', 'wp', RATE, 10000.0, WARM, 'cv_long_short')},
bf AS (SELECT k, symbol, close AS p0 FROM wp WHERE i = {WARM} AND close > 0), bench AS (SELECT k, (arg_max(e, i) / 1 - 1) * 100 AS b FROM (SELECT k, i, avg(close / p0) AS e FROM wp JOIN bf USING (k, symbol) WHERE i >= {WARM} GROUP BY 1, 2) GROUP BY k),
mx AS ({' UNION ALL '.join(parts)})"""


def matrix(spark, sf):
    return shared((spark.sparkContext.applicationId, sf, "matrix"), lambda: build_matrix(spark, sf))


def build_matrix(spark, sf):
    windows = durable(R.split_windows(dense25(spark, sf), NWIN, WARM, min_tradable=60))
    keys = ["window"]
    bench = C.basket_curve(windows.filter(F.col("i") >= WARM), 10_000.0, keys)
    dates = windows.select("window", "i", "date").distinct()
    out = None
    for d in ("long_only", "long_short"):
        w = R.scheduled_weights(windows, LOOK, SKIP, EVERY, NL, NS, d, keys)
        curve = R.rebalanced_curve(windows, w, RATE, 10_000.0, keys, first_row=WARM)
        part = R.curve_report(curve, dates, bench, keys, 365, 10_000.0, F.lit(d)).withColumn("direction", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("market", F.lit("brands"))


@query("rank_matrix", f"""{matrix_sql()} SELECT 'brands' AS market, direction, win::int AS window, bars, nreb AS n_rebalances, round(tot, 4) AS total_return_pct, round(cagr, 4) AS cagr_pct, round(sharpe, 4) AS sharpe,
 round(mdd, 4) AS max_drawdown_pct, round(b, 4) AS benchmark_return_pct, round(excess, 4) AS excess_vs_hurdle_pp, round(sig, 4) AS sigmas_from_zero, round(ag, 4) AS avg_gross_pct, round(an, 4) + 0.0 AS avg_net_pct, round(tx, 4) AS turnover_x_capital, round(fees, 4) AS fees_paid FROM mx""")
def rank_matrix(spark, sf):
    return rounded(matrix(spark, sf).drop("hurdle_pct"), 4)


@query("rank_verdict", f"""{matrix_sql()} SELECT 'brands' AS market, direction, count(*) FILTER (excess > 0) AS wins, count(*) AS windows, round(min(excess), 4) AS lo, round(max(excess), 4) AS hi, round(max(excess) - min(excess), 4) AS spread,
 CASE WHEN count(*) FILTER (excess > 0) = count(*) THEN 'consistent' WHEN count(*) FILTER (excess > 0) = 0 THEN 'negative' ELSE 'flips' END AS sign FROM mx WHERE win > 0 GROUP BY direction""")
def rank_verdict(spark, sf):
    return rounded(R.verdict(matrix(spark, sf)), 4)


@query("basket_daily", f"{D25}, f AS (SELECT symbol, close AS p0 FROM d WHERE i = 0 AND close > 0) SELECT i::bigint AS i, round(avg(close / p0) * 10000, 4) AS equity FROM d JOIN f USING (symbol) GROUP BY i")
def basket_daily(spark, sf):
    return rounded(C.basket_curve(dense25(spark, sf), 10_000.0), 4)


# --- screen ------------------------------------------------------------------------------------

BENCH = "1-URGENT"


def screen_sql(cut: str = "") -> str:
    return f"""{D5}, sc AS (SELECT * FROM d {cut}), rc AS (SELECT sc.* FROM sc, (SELECT max(date) AS mx FROM sc) WHERE date >= mx - INTERVAL 10 YEAR),
me AS (SELECT symbol, date_trunc('month', date)::date AS month, arg_max(close, date) AS close FROM rc GROUP BY 1, 2),
mr AS (SELECT symbol, month, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS ret FROM me),
pr AS (SELECT a.symbol, a.month, a.ret, b.ret AS bench FROM mr a JOIN mr b ON b.month = a.month AND b.symbol = '{BENCH}' WHERE a.symbol <> '{BENCH}' AND a.ret IS NOT NULL AND b.ret IS NOT NULL),
ro AS (SELECT *, CASE WHEN count(*) OVER f = 36 THEN corr(ret, bench) OVER f END AS roll FROM pr WINDOW f AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)),
ag AS (SELECT symbol, corr(ret, bench) AS c, min(roll) AS lo, coalesce(max(roll), corr(ret, bench)) AS hi, (power(product(1 + ret), 12.0 / count(*)) - 1) * 100 AS cagr, count(*) AS months FROM ro GROUP BY symbol HAVING count(*) >= 60),
sn AS (SELECT symbol, round(c, 6) AS corr, round(lo, 6) AS roll_min, round(hi, 6) AS roll_max, round(cagr, 6) AS cagr_pct, months,
 CASE WHEN cagr <= 0 AND c <= -0.30 THEN 'trap' WHEN cagr <= 0 THEN 'losing' WHEN c > 0.40 THEN 'correlated' WHEN hi > 0.60 THEN 'unstable' ELSE 'candidate' END AS verdict FROM ag)"""


@query("monthly_returns", f"{screen_sql()} SELECT symbol, month, round(ret, 6) + 0.0 AS ret FROM mr WHERE ret IS NOT NULL")
def monthly_returns(spark, sf):
    return rounded(S.monthly_returns(dense5(spark, sf)))


@query("screen", f"{screen_sql()} SELECT * FROM sn")
def screen(spark, sf):
    return rounded(S.screen(dense5(spark, sf), BENCH))


@query("screen_as_of", f"{screen_sql(chr(10) + chr(32) + 'WHERE date < DATE ' + repr('2001-03-15'))} SELECT *, DATE '2001-03-15' AS as_of FROM sn")
def screen_as_of(spark, sf):
    return rounded(S.screen(dense5(spark, sf), BENCH, as_of="2001-03-15"))


@query("screen_counts", f"{screen_sql()} SELECT count(*) AS screened, count(*) FILTER (corr < 0) AS negatives, count(*) FILTER (verdict = 'candidate') AS candidates, count(*) FILTER (corr < 0 AND cagr_pct > 0) AS negative_and_earning FROM sn")
def screen_counts(spark, sf):
    return S.screen_counts(S.screen(dense5(spark, sf), BENCH))


@query("rolling_corr", f"{screen_sql()} SELECT symbol, month, round(roll, 6) AS roll FROM ro")
def rolling_corr(spark, sf):
    pairs = S.pairs_with_benchmark(S.monthly_returns(dense5(spark, sf)), BENCH)
    return rounded(S.rolling_correlation(pairs).select("symbol", "month", "roll"))


# --- portfolio tables --------------------------------------------------------------------------
# Books: one per customer; holdings from their orders by priority, targets and prices alike.

PORT = f"""ho AS (SELECT o_custkey AS book, o_orderpriority AS symbol, sum(o_orderkey % 50 + 1)::double AS qty FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
tg0 AS (SELECT o_custkey AS book, o_orderpriority AS symbol, count(*)::double AS weight FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2), tg AS (SELECT book, symbol, weight / sum(weight) OVER (PARTITION BY book) AS weight FROM tg0),
px AS (SELECT o_orderpriority AS symbol, sum(round(o_totalprice * 100)::bigint) / 100.0::double / count(*) / 1000 AS price FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
ca AS (SELECT c_custkey AS book, (c_custkey % 100) * 100.0::double AS cash FROM customer),
u AS (SELECT coalesce(ho.book, tg.book) AS book, coalesce(ho.symbol, tg.symbol) AS symbol, coalesce(qty, 0) AS qty, coalesce(weight, 0) AS weight FROM ho FULL JOIN tg ON ho.book = tg.book AND ho.symbol = tg.symbol),
va AS (SELECT u.*, coalesce(price, 0) AS price, qty * coalesce(price, 0) AS value FROM u LEFT JOIN px USING (symbol)),
vt AS (SELECT va.*, cash, sum(value) OVER (PARTITION BY va.book) + cash AS total FROM va JOIN ca USING (book))"""


def books(spark, sf):
    o = inputs.table(spark, sf, "orders").withColumnsRenamed({"o_custkey": "book", "o_orderpriority": "symbol"})
    holdings = o.filter("o_orderstatus <> 'P'").groupBy("book", "symbol").agg(F.sum(F.col("o_orderkey") % 50 + 1).cast("double").alias("qty"))
    targets = P.base_weights(o.filter("o_orderstatus <> 'F'").groupBy("book", "symbol").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    prices = o.filter("symbol <> '5-LOW'").groupBy("symbol").agg((cents / 100.0 / F.count(F.lit(1)) / 1000).alias("price"))
    cash = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("book"), ((F.col("c_custkey") % 100) * 100.0).alias("cash"))
    return holdings, targets, prices, cash


def valued(spark, sf):
    holdings, targets, prices, cash = books(spark, sf)
    return P.valued(holdings, cash, prices, targets)


@query("weights_norm", f"WITH {PORT} SELECT book, symbol, round(weight, 6) AS weight FROM tg")
def weights_norm(spark, sf):
    return rounded(books(spark, sf)[1].select("book", "symbol", "weight"))


@query("portfolio_value", f"WITH {PORT} SELECT book, round(any_value(total), 6) AS total FROM vt GROUP BY book")
def portfolio_value(spark, sf):
    return rounded(P.portfolio_value(valued(spark, sf)))


@query("current_weights", f"""WITH {PORT}, c AS (SELECT *, value / total AS cur FROM vt WHERE total > 0) SELECT book, symbol, round(cur, 6) AS current, round(weight, 6) AS weight,
 CASE WHEN (cur - weight) * 100 >= 3 THEN 'over' WHEN (cur - weight) * 100 <= -3 THEN 'under' ELSE 'on_target' END AS flag FROM c""")
def current_weights(spark, sf):
    c = P.current_weights(valued(spark, sf))
    return rounded(c.select("book", "symbol", "current", "weight", drift_flag("current", "weight").alias("flag")))


@query("drift", f"""WITH {PORT}, c AS (SELECT *, CASE WHEN total > 0 THEN abs(value / total - weight) * 100 ELSE 0 END AS gap FROM vt)
SELECT book, round(max(gap), 6) AS max_drift_pp, arg_max(symbol, struct_pack(gap, symbol)) AS worst_symbol, max(gap) >= 25 OR book % 30 >= 20 AS due FROM c GROUP BY book""")
def drift(spark, sf):
    d = P.drift(valued(spark, sf))
    return rounded(d.select("book", "max_drift_pp", "worst_symbol", P.rebalance_due(F.col("book") % 30, F.col("max_drift_pp"), 20, 25.0).alias("due")))


ORDERS_SQL = f"{PORT}, od AS (SELECT *, weight * total - value AS delta, abs(weight * total - value) / price AS oq FROM vt WHERE price > 0 AND abs(weight * total - value) >= 1)"


@query("orders", f"WITH {ORDERS_SQL} SELECT book, symbol, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, round(oq, 6) AS qty FROM od")
def orders(spark, sf):
    return rounded(P.orders(valued(spark, sf)).select("book", "symbol", "side", F.col("order_qty").alias("qty")))


SETTLE = f"""{ORDERS_SQL}, s0 AS (SELECT *, delta > 0 AS buy, CASE WHEN delta > 0 THEN price * 1.0002::double ELSE price * 0.9998::double END AS fp FROM od),
s1 AS (SELECT *, CASE WHEN buy THEN 0 ELSE least(oq, qty) END AS sold, CASE WHEN buy THEN oq * fp * 1.001::double ELSE 0 END AS want FROM s0),
s2 AS (SELECT *, cash + sum(CASE WHEN sold > 1e-9 THEN sold * fp * 0.999::double ELSE 0 END) OVER (PARTITION BY book) AS avail, sum(want) OVER (PARTITION BY book ORDER BY buy, symbol) - want AS before FROM s1),
s3 AS (SELECT *, CASE WHEN buy THEN least(want, greatest(0, avail - before)) / (fp * 1.001::double) ELSE sold END AS fq FROM s2),
fi AS (SELECT book, symbol, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS side, fq, fp, fq * fp AS notional, fq * fp * 0.001::double AS fee FROM s3 WHERE fq > 1e-9)"""


@query("settlement", f"WITH {SETTLE} SELECT book, symbol, side, round(fq, 6) AS filled_qty, round(fp, 6) AS fill_price, round(notional, 6) AS notional, round(fee, 6) AS fee FROM fi")
def settlement(spark, sf):
    fills = P.settle(P.orders(valued(spark, sf)), Costs())
    return rounded(fills.select("book", "symbol", "side", "filled_qty", "fill_price", "notional", "fee"))


@query("cash_after", f"WITH {SETTLE} SELECT ca.book, round(cash + coalesce(f, 0), 4) + 0.0 AS cash FROM ca LEFT JOIN (SELECT book, sum(CASE WHEN side = 'sell' THEN notional - fee ELSE -notional - fee END) AS f FROM fi GROUP BY book) USING (book)")
def cash_after(spark, sf):
    fills = P.settle(P.orders(valued(spark, sf)), Costs())
    return rounded(P.cash_after(fills, books(spark, sf)[3]), 4)


MA, SAFE = 50, "3-MEDIUM"
BASE_W = {"1-URGENT": 0.4, "2-HIGH": 0.2, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.1, "5-LOW": 0.1}
BW = "bw(symbol, weight) AS (VALUES " + ", ".join(f"('{s}', {w}::double)" for s, w in BASE_W.items()) + ")"
TREND = f"""{BW}, tr AS (SELECT i, CASE WHEN i + 1 >= {MA} AND close < avg(close) OVER (PARTITION BY d.symbol ORDER BY i ROWS BETWEEN {MA - 1} PRECEDING AND CURRENT ROW) THEN '{SAFE}' ELSE d.symbol END AS symbol, weight FROM d JOIN bw ON bw.symbol = d.symbol),
tw AS (SELECT i, symbol, sum(weight) AS weight FROM tr GROUP BY 1, 2)"""


def base(spark):
    return spark.createDataFrame(list(BASE_W.items()), "symbol string, weight double")


@query("trend_weights", f"{D5}, {TREND} SELECT i::bigint AS i, symbol, round(weight, 6) AS weight FROM tw")
def trend_weights(spark, sf):
    return rounded(P.trend_weights(dense5(spark, sf), base(spark), MA, SAFE).select("i", "symbol", "weight"))


@query("weighted_basket", f"{D5}, {BW}, f AS (SELECT symbol, close AS p0 FROM d WHERE i = 0) SELECT i::bigint AS i, round(sum(weight * close / p0) * 10000, 4) AS equity FROM d JOIN f USING (symbol) JOIN bw USING (symbol) GROUP BY i")
def weighted_basket(spark, sf):
    return rounded(C.basket_curve(dense5(spark, sf), 10_000.0, weights=base(spark)), 4)


CAD, BAND = 30, 25.0


def schedule_sql() -> str:
    return f"""{BW}, pa AS (SELECT a.i AS a, t.i AS t, a.symbol, w.weight, w.weight * t.close / a.close AS v FROM d a JOIN bw w USING (symbol) JOIN d t ON t.symbol = a.symbol AND t.i BETWEEN a.i + 1 AND a.i + {CAD}),
pt AS (SELECT a, t, max(abs(v / (tot) - weight)) * 100 AS dr FROM (SELECT *, sum(v) OVER (PARTITION BY a, t) + 1 - sum(weight) OVER (PARTITION BY a, t) AS tot FROM pa) GROUP BY 1, 2),
jp AS MATERIALIZED (SELECT a, min(t) AS t, arg_min(dr, t) AS dr FROM pt WHERE t - a >= {CAD} OR dr >= {BAND} GROUP BY a),
sch AS (SELECT 0::bigint AS i, NULL::double AS dr UNION ALL SELECT jp.t, jp.dr FROM sch JOIN jp ON jp.a = sch.i)"""


def fixed_targets(spark, sf):
    return dense5(spark, sf).select("i", "symbol").join(F.broadcast(base(spark)), "symbol")


@query("rebalance_schedule", f"{D5}, {schedule_sql()} SELECT i, round(dr, 6) AS drift_pp FROM sch")
def rebalance_schedule(spark, sf):
    return rounded(P.rebalance_schedule(dense5(spark, sf), fixed_targets(spark, sf), CAD, BAND))


PF_CURVE = f"""{D5}, {schedule_sql()}, kw AS (SELECT 0 AS k, d.i, d.symbol, bw.weight, d.close AS price FROM sch JOIN d USING (i) JOIN bw USING (symbol)), kp AS (SELECT 0 AS k, * FROM d), {curve_sql('kw', 'kp', 0.0012, 10000.0, 0, 'cv', ter=0.000005)},
kb AS (SELECT * FROM kw WHERE i = 0), {curve_sql('kb', 'kp', 0.0012, 10000.0, 0, 'bv', ter=0.000005)}"""


def portfolio_curves(spark, sf):
    p = dense5(spark, sf)
    plan = durable(P.rebalance_schedule(p, fixed_targets(spark, sf), CAD, BAND).select("i"))
    w = p.join(plan, "i").join(F.broadcast(base(spark)), "symbol").select("i", "symbol", "weight", F.col("close").alias("price"))
    curve = R.rebalanced_curve(p, w, 0.0012, 10_000.0, daily_drag=0.000005)
    hold = R.rebalanced_curve(p, w.filter("i = 0"), 0.0012, 10_000.0, daily_drag=0.000005)
    return curve, hold


@query("portfolio_curve", f"{PF_CURVE} SELECT i::bigint AS i, round(cv.equity, 4) AS equity, round(bv.equity, 4) AS benchmark, round(cv.cost, 4) AS cost FROM cv JOIN bv USING (i)")
def portfolio_curve(spark, sf):
    curve, hold = portfolio_curves(spark, sf)
    return rounded(curve.select("i", "equity", "cost").join(hold.select("i", F.col("equity").alias("benchmark")), "i"), 4)


@query("portfolio_summary", f"""{PF_CURVE}, r AS (SELECT i, cv.equity, cv.cost, cv.equity / lag(cv.equity) OVER s - 1 AS ret, cv.equity / max(cv.equity) OVER s - 1 AS dd, bv.equity AS b FROM cv JOIN bv USING (i) WINDOW s AS (ORDER BY i))
SELECT round((arg_max(equity, i) / 10000 - 1) * 100, 4) AS total_return_pct, round((arg_max(b, i) / 10000 - 1) * 100, 4) AS benchmark_return_pct, round((power(arg_max(equity, i) / arg_min(equity, i), 252.0 / count(*)) - 1) * 100, 4) AS cagr_pct,
 round(stddev_samp(ret) * sqrt(252.0) * 100, 4) AS volatility_pct, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 4) AS sharpe, round(min(dd) * 100, 4) AS max_drawdown_pct, count(cost) AS n_rebalances, round(sum(cost), 4) AS fees_paid FROM r""")
def portfolio_summary(spark, sf):
    from tickloom.operators import metrics as M
    curve, hold = portfolio_curves(spark, sf)
    full = M.with_drawdown(M.with_returns(curve, []), []).join(hold.select("i", F.col("equity").alias("b")), "i")
    last, first = F.max_by("equity", "i"), F.min_by("equity", "i")
    return rounded(full.agg(
        ((last / 10_000.0 - 1) * 100).alias("total_return_pct"), ((F.max_by("b", "i") / 10_000.0 - 1) * 100).alias("benchmark_return_pct"),
        M.cagr_pct(first, last, F.count(F.lit(1)) / 252.0).alias("cagr_pct"), (F.stddev_samp("ret") * 252.0 ** 0.5 * 100).alias("volatility_pct"),
        M.sharpe("ret", 252.0).alias("sharpe"), (F.min("drawdown") * 100).alias("max_drawdown_pct"), F.count("cost").alias("n_rebalances"),
        F.sum("cost").alias("fees_paid")), 4)
