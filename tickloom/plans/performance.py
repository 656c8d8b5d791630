"""Metrics, curves and alerts over the accounts the evaluated trades produce."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.scalars import alert_category, local_clock, open_pnl
from tickloom.functions.timeframes import epoch_ms, periods_per_year, to_ts
from tickloom.operators import alerts as A
from tickloom.operators import bars as B
from tickloom.operators import curves as C
from tickloom.operators import metrics as M
from tickloom.operators import outcomes as O
from tickloom.plans import inputs
from tickloom.plans.common import TICKS, bars_cte, rounded, to_ts_sql
from tickloom.plans.trading import BASE, EQUITY, H1, RULES, booked, chain_sql, equity, sig_sql, signals

QUERIES: dict = {}
ORACLE: dict = {}
DAY = 86_400_000


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


TRADES = f"{BASE}, {chain_sql()}"
CURVE = f"{TRADES}, {EQUITY}"
W = "WINDOW s AS (PARTITION BY symbol ORDER BY i)"
CLOSED = "closed AS (SELECT * FROM trades WHERE exit_reason IS NOT NULL)"


def closed(spark, sf):
    return booked(spark, sf).filter(F.col("exit_reason").isNotNull())


@query("trade_summary", f"""{TRADES}, {CLOSED} SELECT symbol, count(*) AS n_trades, round(avg((pnl > 0)::int) * 100, 6) AS win_rate_pct,
 round(CASE WHEN sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END) < 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / -sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END) ELSE 'inf'::double END, 6) AS profit_factor,
 round(avg(pnl), 6) AS avg_trade_pnl, round(sum(fees), 6) AS fees_paid, round(sum(pnl) + sum(fees), 6) AS gross_pnl, round(sum(pnl), 6) AS net_pnl,
 round(avg((exit_ms - entry_ms) / 3600000.0::double), 6) AS avg_hours, count(*) FILTER (exit_reason = 'tp') AS exits_tp, count(*) FILTER (exit_reason = 'sl') AS exits_sl,
 count(*) FILTER (exit_reason = 'timeout') AS exits_timeout, count(*) FILTER (exit_reason NOT IN ('tp', 'sl', 'timeout')) AS exits_other FROM closed GROUP BY symbol""")
def trade_summary(spark, sf):
    return rounded(M.trade_summary(closed(spark, sf), ["symbol"]))


@query("by_side", f"{TRADES}, {CLOSED} SELECT side::int AS side, count(*) AS trades, round(sum(pnl), 6) AS pnl FROM closed GROUP BY side")
def by_side(spark, sf):
    return rounded(closed(spark, sf).groupBy("side").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("pnl")))


@query("by_symbol", f"{TRADES}, {CLOSED} SELECT symbol, count(*) AS trades, round(sum(pnl), 6) AS pnl, round(avg(r) * 100, 6) AS mean_r_pct FROM closed GROUP BY symbol")
def by_symbol(spark, sf):
    return rounded(closed(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("pnl"), (F.avg("r") * 100).alias("mean_r_pct")).orderBy(F.desc("pnl")))


@query("exit_reasons", f"{TRADES}, {CLOSED} SELECT symbol, string_agg(exit_reason || '=' || n, ',' ORDER BY exit_reason) AS exits FROM (SELECT symbol, exit_reason, count(*) AS n FROM closed GROUP BY 1, 2) GROUP BY symbol")
def exit_reasons(spark, sf):
    m = M.exit_map(closed(spark, sf), ["symbol"])
    entries = F.transform(F.map_entries("exits"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("symbol", F.array_join(F.sort_array(entries), ",").alias("exits"))


@query("pnl_histogram", f"""{TRADES}, {CLOSED}, b AS (SELECT min(pnl) AS lo, max(pnl) AS hi FROM closed)
SELECT least(floor((pnl - lo) / ((hi - lo) / 30)), 29)::bigint AS bin, count(*) AS n FROM closed, b GROUP BY 1""")
def pnl_histogram(spark, sf):
    return M.histogram(closed(spark, sf), "pnl", 30).select("bin", "n")


@query("signal_funnel", f"""{TRADES} SELECT s.symbol, t.n_trades AS n_signals, t.n_trades AS n_fills, 100.0::double AS fill_rate_pct, t.n_trades, t.rollovers, round(s.median_tp_pct, 6) AS median_tp_pct FROM
 (SELECT symbol, median(1.5 * atr / close * 100) AS median_tp_pct FROM sig GROUP BY symbol) s
 JOIN (SELECT symbol, count(*) AS n_trades, sum(rolls)::bigint AS rollovers FROM trades GROUP BY symbol) t USING (symbol)""")
def signal_funnel(spark, sf):
    from tickloom.operators.chunking import exact_quantile
    s = signals(spark, sf)
    funnel = O.signal_counts(O.chain(O.legs(s, RULES), RULES.reach))
    reach = s.withColumn("tp_pct", F.col("atr") * 1.5 / F.col("close") * 100)
    median = exact_quantile(reach, ["symbol"], "tp_pct", {"median_tp_pct": 0.5}, "i")
    t = booked(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), F.sum("rollovers").alias("rollovers"))
    return rounded(funnel.join(t, "symbol").join(median, "symbol"))


@query("no_entry_reasons", f"""{TRADES}, o AS (SELECT s.*, EXISTS (SELECT 1 FROM trades t WHERE t.symbol = s.symbol AND s.i > t.entry_i AND (t.exit_i IS NULL OR s.i < t.exit_i)) AS inpos FROM sig s)
SELECT symbol, CASE WHEN inpos THEN 'in_position' WHEN i < 60 THEN 'warmup' WHEN p_long IS NULL THEN 'features_nan' WHEN atr IS NULL OR atr <= 0 THEN 'no_atr' WHEN greatest(p_long, p_short) < 0.8 THEN 'below_threshold'
  WHEN ms % 7200000 = 0 THEN 'risk_blocked' ELSE 'entered' END AS reason, count(*) AS n FROM o GROUP BY 1, 2""")
def no_entry_reasons(spark, sf):
    from tickloom.operators import labels as L
    from tickloom.operators.chunking import running
    s = signals(spark, sf)
    t = booked(spark, sf).select("symbol", F.col("entry_i").alias("i"), F.struct(F.col("entry_i"), F.col("exit_i")).alias("_t"))
    cur = running(s.join(t, ["symbol", "i"], "left"), ["symbol"], {"_cur": ("last", F.col("_t"))})
    # a bar that is itself an entry may still lie inside nothing: look at the trade strictly before it
    inside = F.col("_cur").isNotNull() & (F.col("i") > F.col("_cur.entry_i")) & (F.col("_cur.exit_i").isNull() | (F.col("i") < F.col("_cur.exit_i")))
    reason = L.no_entry_reason(inside, F.col("i"), 60, F.col("p_long").isNotNull(), F.col("atr"), F.greatest("p_long", "p_short"), 0.8, F.col("ms") % 7_200_000 == 0)
    return cur.withColumn("reason", reason).groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("concurrency", f"""{TRADES}, {CLOSED}, m AS (SELECT entry_ms AS ms, 1 AS d FROM closed UNION ALL SELECT exit_ms, -1 FROM closed), net AS (SELECT ms, sum(d) AS d FROM m GROUP BY ms)
SELECT max(o)::bigint AS peak_open FROM (SELECT sum(d) OVER (ORDER BY ms) AS o FROM net)""")
def concurrency(spark, sf):
    return O.peak_concurrency(closed(spark, sf), H1)


BOOK = "CASE WHEN symbol IN ('click', 'error') THEN 'a' ELSE 'b' END"


@query("daily_loss_switch", f"""{CURVE}, {CLOSED}, de AS (SELECT {BOOK} AS book, day, sum(e) AS day_equity FROM (SELECT symbol, ms // {DAY} AS day, arg_min(equity, ms) AS e FROM eq GROUP BY 1, 2) GROUP BY 1, 2),
r AS (SELECT {BOOK} AS book, exit_ms // {DAY} AS day, exit_ms, symbol, sum(pnl) OVER (PARTITION BY {BOOK}, exit_ms // {DAY} ORDER BY exit_ms, symbol ROWS UNBOUNDED PRECEDING) AS realised FROM closed)
SELECT book, day, {to_ts_sql('min(exit_ms)')} AS stopped_at, round(arg_min(realised, struct_pack(exit_ms, symbol)), 6) AS realised, round(any_value(day_equity), 6) AS day_equity FROM r JOIN de USING (book, day) WHERE realised <= -0.005::double * day_equity GROUP BY 1, 2""")
def daily_loss_switch(spark, sf):
    eq = equity(spark, sf)
    book = F.when(F.col("symbol").isin("click", "error"), "a").otherwise("b").alias("book")
    start = eq.groupBy("symbol", F.floor(F.col("ms") / DAY).cast("long").alias("day")).agg(F.min_by("equity", "ms").alias("_e"))
    start = start.groupBy(book, "day").agg(F.sum("_e").alias("day_equity"))
    out = O.daily_loss_switch(closed(spark, sf).withColumn("book", book), start, 0.005)
    return rounded(out.select("book", "day", to_ts("stopped_ms").alias("stopped_at"), "realised", "day_equity"))


@query("drawdown", f"{CURVE} SELECT symbol, {to_ts_sql('ms')} AS ts, round(max(equity) OVER s, 6) AS peak, round(equity / max(equity) OVER s - 1, 6) + 0.0 AS drawdown FROM eq {W}")
def drawdown(spark, sf):
    return rounded(B.with_ts(M.with_drawdown(equity(spark, sf), ["symbol"])).select("symbol", "ts", "peak", "drawdown"))


SUMMARY = f"""{CURVE}, c AS (SELECT *, equity / lag(equity) OVER s - 1 AS ret, equity / max(equity) OVER s - 1 AS dd, least(greatest(coalesce(greatest(equity - cash, 0) / nullif(equity, 0), 0), 0), 1) AS x FROM eq {W}),
a AS (SELECT symbol, count(*) AS bars, arg_max(equity, i) AS fe, min(dd) * 100 AS mdd, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(8760.0), 0) AS sharpe, avg(x) * 100 AS ax, avg((x > 0)::int) * 100 AS tm FROM c GROUP BY symbol)
SELECT symbol, bars, round(fe, 6) AS final_equity, round((fe / 10000 - 1) * 100, 6) AS total_return_pct, round(mdd, 6) AS max_drawdown_pct, round(sharpe, 6) AS sharpe, round(ax, 6) AS avg_exposure_pct,
 round(tm, 6) AS time_in_market_pct, round(CASE WHEN ax >= 10 THEN (fe / 10000 - 1) * 100 / (ax / 100) END, 6) AS return_on_risked_pct FROM a"""


@query("equity_summary", SUMMARY)
def equity_summary(spark, sf):
    return rounded(M.curve_summary(equity(spark, sf), ["symbol"], periods_per_year("1h"), RULES.initial))


@query("net_positive", f"SELECT bool_and(total_return_pct > 0) AS all_positive, count(*) FILTER (total_return_pct > 0) AS positive FROM ({SUMMARY})")
def net_positive(spark, sf):
    s = M.curve_summary(equity(spark, sf), ["symbol"], periods_per_year("1h"), RULES.initial)
    return s.agg(F.bool_and(F.col("total_return_pct") > 0).alias("all_positive"), F.count_if(F.col("total_return_pct") > 0).alias("positive"))


# Journal: every tick appends a row; several rows share a bar, the last one counts.
JOURNAL = f"WITH {TICKS}, j AS (SELECT symbol AS book, ms - ms % 3600000 AS ms, event_id AS seq, 1000 + price AS equity, 1000 - price / 2 AS cash FROM ticks)"


def journal(spark, sf):
    return inputs.ticks(spark, sf).select(
        F.col("symbol").alias("book"), (F.col("ms") - F.col("ms") % H1).alias("ms"), F.col("event_id").alias("seq"),
        (F.col("price") + 1000).alias("equity"), (1000 - F.col("price") / 2).alias("cash"))


@query("equity_last", f"{JOURNAL} SELECT book, {to_ts_sql('ms')} AS ts, round(arg_max(equity, seq), 6) AS equity, round(arg_max(cash, seq), 6) AS cash FROM j GROUP BY book, ms")
def equity_last(spark, sf):
    return rounded(B.with_ts(M.last_per_timestamp(journal(spark, sf), ["book"], ["equity", "cash"])).select("book", "ts", "equity", "cash"))


@query("money_at_work", f"""{JOURNAL}, l AS (SELECT book, ms, arg_max(equity, seq) AS equity, arg_max(cash, seq) AS cash FROM j GROUP BY book, ms)
SELECT book, round(avg(least(greatest(greatest(equity - cash, 0) / equity, 0), 1)) * 100, 6) AS avg_exposure_pct FROM l GROUP BY book""")
def money_at_work(spark, sf):
    last = M.last_per_timestamp(journal(spark, sf), ["book"], ["equity", "cash"])
    return rounded(last.groupBy("book").agg((F.avg(M.exposure()) * 100).alias("avg_exposure_pct")))


@query("recent_rows", f"WITH {TICKS}, {bars_cte('1h')} SELECT symbol, {to_ts_sql('ms')} AS ts, close FROM (SELECT *, max(ms) OVER (PARTITION BY symbol) AS mx FROM bars) WHERE ms >= mx - 7::bigint * {DAY}")
def recent_rows(spark, sf):
    return B.with_ts(M.recent(inputs.bars(spark, sf), 7, ["symbol"])).select("symbol", "ts", "close")


@query("recent_around_event", f"""WITH {TICKS}, {bars_cte('1h')} SELECT symbol, count(*) AS bars FROM (SELECT *, max(ms) OVER (PARTITION BY symbol) AS mx FROM bars)
WHERE ms >= least(mx - 7::bigint * {DAY}, 1705312800000 - {DAY}) GROUP BY symbol""")
def recent_around_event(spark, sf):
    wide = M.recent(inputs.bars(spark, sf), 7, ["symbol"], at=F.lit(1705312800000))
    return wide.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


@query("move_24h", f"""WITH {TICKS}, {bars_cte('1h')}, m AS (SELECT *, max(ms) OVER (PARTITION BY symbol) AS mx FROM bars)
SELECT symbol, arg_max(close, ms) AS last_close, round(arg_max(close, ms) / (arg_max(close, ms) FILTER (ms <= mx - 86400000)) * 100 - 100, 6) AS move_pct FROM m GROUP BY symbol""")
def move_24h(spark, sf):
    return rounded(M.move_pct(inputs.bars(spark, sf), 24))


# --- benchmark curves over the bar closes ------------------------------------------------------

DENSE = """g AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i FROM (SELECT DISTINCT ms FROM bars)), sy AS (SELECT DISTINCT symbol FROM bars),
d AS (SELECT g.ms, g.i, sy.symbol, last_value(b.close IGNORE NULLS) OVER (PARTITION BY sy.symbol ORDER BY g.ms) AS close FROM g CROSS JOIN sy LEFT JOIN bars b ON b.symbol = sy.symbol AND b.ms = g.ms)"""
BARS = f"WITH {TICKS}, {bars_cte('1h')}, {DENSE}"


def hourly_panel(spark, sf):
    b = inputs.bars(spark, sf).select("symbol", "ms", "close")
    return C.dense_panel(b, date="ms")


@query("equal_weight_curve", f"""{BARS}, f AS (SELECT symbol, close AS p0 FROM d WHERE i = 0 AND close > 0)
SELECT {to_ts_sql('d.ms')} AS ts, round(avg(close / p0) * 10000, 6) AS equity FROM d JOIN f USING (symbol) GROUP BY d.ms""")
def equal_weight_curve(spark, sf):
    p = hourly_panel(spark, sf)
    curve = C.basket_curve(p, 10_000.0, order="ms")
    return rounded(B.with_ts(curve).select("ts", "equity"))


@query("matched_exposure", f"""{CURVE.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}, {DENSE},
mv AS (SELECT i, ms, coalesce(avg(chg), 0) AS basket FROM (SELECT i, ms, close / lag(close) OVER (PARTITION BY symbol ORDER BY i) - 1 AS chg FROM d) GROUP BY 1, 2),
ac AS (SELECT ms, sum(equity) AS equity, sum(cash) AS cash FROM eq GROUP BY ms),
ex AS (SELECT mv.*, coalesce(last_value(least(greatest(greatest(equity - cash, 0) / equity, 0), 1) IGNORE NULLS) OVER (ORDER BY mv.i), 0) AS x FROM mv LEFT JOIN ac USING (ms)),
gr AS (SELECT *, 1 + coalesce(lag(x) OVER (ORDER BY i), 0) * basket AS growth FROM ex)
SELECT {to_ts_sql('ms')} AS ts, round(basket, 6) + 0.0 AS basket, round(x, 6) + 0.0 AS exposure, round(product(growth) OVER (ORDER BY i) * 50000, 4) AS equity FROM gr""")
def matched_exposure(spark, sf):
    p = hourly_panel(spark, sf)
    dates = p.select("ms", "i").distinct()
    account = equity(spark, sf).groupBy("ms").agg(F.sum("equity").alias("equity"), F.sum("cash").alias("cash")).join(dates, "ms")
    out = C.matched_exposure(p.select("symbol", "i", "close"), account.drop("ms"), 50_000.0).join(dates, "i")
    out = out.withColumn("equity", F.round("equity", 4))
    return rounded(B.with_ts(out).select("ts", "basket", "exposure", "equity"), skip=("equity",))


# --- alerts and live state ---------------------------------------------------------------------

@query("drawdown_alerts", f"""{CURVE}, dd AS (SELECT *, equity / max(equity) OVER s - 1 AS dd FROM eq {W}),
mk AS (SELECT *, coalesce(last_value(CASE WHEN dd <= -0.01::double THEN 1 WHEN dd > -0.005::double THEN 0 END IGNORE NULLS) OVER s, 0) AS st FROM dd {W}),
al AS (SELECT *, coalesce(lag(st) OVER s, 0) AS was FROM mk {W})
SELECT symbol, {to_ts_sql('ms')} AS ts, round(dd, 6) AS drawdown FROM al WHERE st = 1 AND was = 0""")
def drawdown_alerts(spark, sf):
    return rounded(B.with_ts(A.drawdown_alerts(equity(spark, sf), ["symbol"], 0.01)).select("symbol", "ts", "drawdown"))




@query("stale_keys", f"""WITH {TICKS}, {bars_cte('15m')}, m AS (SELECT symbol, max(ms) AS last_ms FROM bars GROUP BY symbol), n AS (SELECT max(last_ms) + 2700000 AS now FROM m)
SELECT symbol, {to_ts_sql('last_ms')} AS last_ts, now - last_ms - 900000 AS overdue_ms, now - last_ms - 900000 > 900000 + 900000 AS stale FROM m, n""")
def stale_keys(spark, sf):
    b = inputs.bars(spark, sf, "15m").select("symbol", "ms")
    now = b.agg((F.max("ms") + 2_700_000).alias("now"))
    newest = b.groupBy("symbol").agg(F.max("ms").alias("ms")).crossJoin(F.broadcast(now))
    flagged = A.stale_keys(newest, 900_000, F.col("now"), keys=["symbol", "now"])
    return flagged.select("symbol", to_ts("last_ms").alias("last_ts"), "overdue_ms", "stale")


@query("heartbeat_status", f"""WITH {TICKS}, m AS (SELECT symbol, max(ms) AS u FROM ticks GROUP BY symbol), n AS (SELECT max(u) AS now FROM m)
SELECT symbol, CASE WHEN now - u <= 300000 THEN 'fresh' ELSE 'stale' END AS status FROM m, n""")
def heartbeat_status(spark, sf):
    t = inputs.ticks(spark, sf).groupBy("symbol").agg(F.max("ms").alias("u"))
    now = t.agg(F.max("u").alias("now"))
    return t.crossJoin(F.broadcast(now)).select("symbol", A.freshness(F.col("u"), F.col("now"), 300).alias("status"))


@query("daily_freshness", """WITH u AS (SELECT p_brand AS symbol, max(l_shipdate::date) AS d FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 50 GROUP BY 1)
SELECT symbol, CASE WHEN date_diff('day', d, (SELECT max(d) FROM u)) <= 4 THEN 'fresh' ELSE 'stale' END AS status FROM u""")
def daily_freshness(spark, sf):
    """Daily data counts as fresh for four days: the brands' newest full shipments against the newest of all."""
    lines = inputs.table(spark, sf, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"), epoch_ms(F.to_date("l_shipdate")).alias("ms"))
    newest = lines.groupBy("p_partkey").agg(F.max("ms").alias("ms")).join(inputs.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol")), "p_partkey")
    u = newest.groupBy("symbol").agg(F.max("ms").alias("u"))
    return u.crossJoin(F.broadcast(u.agg(F.max("u").alias("now")))).select("symbol", A.freshness(F.col("u"), F.col("now"), 4 * 86_400).alias("status"))


@query("local_hours", "SELECT hour(ts + INTERVAL 1 HOUR)::int AS hour, count(*) AS events, max(ts + INTERVAL 1 HOUR) AS newest FROM events GROUP BY 1")
def local_hours(spark, sf):
    """Events by the hour on a local clock (winter time, one hour ahead of UTC)."""
    local = inputs.table(spark, sf, "events").select(local_clock(F.col("ts").cast("timestamp"), "Europe/Warsaw").cast("timestamp_ntz").alias("at"))
    return local.groupBy(F.hour("at").alias("hour")).agg(F.count(F.lit(1)).alias("events"), F.max("at").alias("newest"))


@query("map_drift", f"""WITH {TICKS}, k AS (SELECT symbol AS book, max(ms) AS ms, max(event_id) AS a, count(*) AS n FROM ticks GROUP BY 1),
l AS (SELECT book, ms, unnest(['size', 'limit', 'slots']) AS key, unnest([a % 3, n % 5, 4]) AS v FROM k), w AS (SELECT book, unnest(['size', 'limit', 'extra']) AS key, unnest([1, 2, 9]) AS v FROM k)
SELECT l.book, l.key, l.v::varchar AS live, w.v::varchar AS desired, l.ms > 1706659000000 AS stuck FROM l JOIN w USING (book, key) WHERE l.v <> w.v""")
def map_drift(spark, sf):
    k = inputs.ticks(spark, sf).groupBy(F.col("symbol").alias("book")).agg(
        F.max("ms").alias("candle_ms"), F.max("event_id").alias("a"), F.count(F.lit(1)).alias("n"))
    text = lambda c: c.cast("string")
    live = k.select("book", "candle_ms", F.create_map(
        F.lit("size"), text(F.col("a") % 3), F.lit("limit"), text(F.col("n") % 5), F.lit("slots"), F.lit("4")).alias("params"))
    desired = k.select("book", F.lit(1706659000000).alias("edited_ms"), F.create_map(
        F.lit("size"), F.lit("1"), F.lit("limit"), F.lit("2"), F.lit("extra"), F.lit("9")).alias("params"))
    return A.map_drift(live, desired).select("book", "key", "live", "desired", "stuck")


@query("cap_rejections", f"""{BASE}, {sig_sql(0.5)}, l AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1),
s AS (SELECT (i % 2)::int AS book, symbol, p_long AS p, CASE WHEN p_long >= 0.3 THEN 'risk_blocked' ELSE 'below_threshold' END AS reason FROM sig)
SELECT book, count(*) AS waiting, round(max(p), 6) AS best_p FROM s WHERE reason = 'risk_blocked' GROUP BY book""")
def cap_rejections(spark, sf):
    s = signals(spark, sf, 0.5)
    reason = F.when(F.col("p_long") >= 0.3, "risk_blocked").otherwise("below_threshold")
    detail = F.when(F.col("p_long") >= 0.3, "max_open_positions reached")
    maps = s.select((F.col("i") % 2).cast("int").alias("book"), F.create_map(
        "symbol", F.struct(reason.alias("reason"), detail.alias("detail"), F.col("p_long").alias("p"))).alias("signals"))
    return rounded(A.cap_rejections(maps))


@query("live_points", f"""{JOURNAL}, e AS (SELECT 'main' AS book, book AS symbol, ms, arg_max(equity, seq) AS equity, arg_max(cash, seq) AS cash FROM j GROUP BY book, ms),
st AS (SELECT max(ms) + 60000 AS u FROM e) SELECT book, symbol, {to_ts_sql('ms')} AS ts, round(equity, 6) AS equity, round(cash, 6) AS cash FROM (
 SELECT book, symbol, ms, equity, cash FROM e UNION ALL SELECT 'main', x.symbol, u, 5000.5, 4000.25 FROM st, (SELECT DISTINCT symbol FROM e) x WHERE x.symbol <> 'error')""")
def live_points(spark, sf):
    e = M.last_per_timestamp(journal(spark, sf), ["book"], ["equity", "cash"]).select(
        F.lit("main").alias("book"), F.col("book").alias("symbol"), "ms", "equity", "cash")
    names = e.filter("symbol <> 'error'").select("symbol").distinct().unionByName(spark.range(1).select(F.lit("ghost").alias("symbol")))
    prices = names.agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.lit(1.0)))).alias("last_close"))
    state = e.agg((F.max("ms") + 60_000).alias("updated_ms")).crossJoin(F.broadcast(prices)).select(
        F.lit("main").alias("book"), "updated_ms", F.lit(5000.5).alias("equity"), F.lit(4000.25).alias("cash"), "last_close")
    return rounded(B.with_ts(A.live_points(e, state)).select("book", "symbol", "ts", "equity", "cash"))


@query("price_extension", f"""WITH {TICKS}, {bars_cte('1h')}, st AS (SELECT symbol, ms, close FROM bars WHERE ms < 1705338000000 AND symbol <> 'error'), mx AS (SELECT symbol, max(ms) AS m FROM st GROUP BY 1)
SELECT symbol, {to_ts_sql('ms')} AS ts, close FROM st UNION ALL SELECT b.symbol, {to_ts_sql('b.ms')}, b.close FROM bars b LEFT JOIN mx USING (symbol) WHERE b.ms >= 1705300000000 AND (m IS NULL OR b.ms > m)""")
def price_extension(spark, sf):
    b = inputs.bars(spark, sf).select("symbol", "ms", "close")
    stored = b.filter((F.col("ms") < 1705338000000) & (F.col("symbol") != "error"))
    return B.with_ts(A.extend_prices(stored, b.filter(F.col("ms") >= 1705300000000))).select("symbol", "ts", "close")


@query("trade_marks", f"""{TRADES}, {CLOSED}, m AS (SELECT symbol, entry_ms AS ms, entry_price AS price, 'entry' AS kind FROM closed UNION ALL SELECT symbol, exit_ms, exit_price, 'exit' FROM closed
 UNION ALL SELECT symbol, entry_ms, entry_price, 'held' FROM trades WHERE exit_reason IS NULL
 UNION ALL SELECT event_type, epoch_us(ts) // 1000, value, CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END FROM events)
SELECT symbol, {to_ts_sql('ms')} AS ts, round(price, 6) AS price, kind FROM m WHERE ms BETWEEN 1704500000000 AND 1706000000000""")
def trade_marks(spark, sf):
    t = booked(spark, sf)
    fills = inputs.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), epoch_ms("ts").alias("ms"), F.col("value").alias("price"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"))
    marks = A.trade_marks(t.filter(F.col("exit_reason").isNotNull()), fills, t.filter(F.col("exit_reason").isNull()))
    return rounded(B.with_ts(A.clip_marks(marks, F.lit(1704500000000), F.lit(1706000000000))).select("symbol", "ts", "price", "kind"))


@query("first_seen_order", f"""WITH {TICKS}, d AS (SELECT symbol, ms - ms % {DAY} AS day, min(struct_pack(ts, event_id)) AS f FROM ticks GROUP BY 1, 2)
SELECT {to_ts_sql('day')} AS ts, string_agg(symbol, ',' ORDER BY f) AS symbols FROM d GROUP BY day""")
def first_seen_order(spark, sf):
    """Distinct symbols of a day in the order in which they first came."""
    t = inputs.ticks(spark, sf).withColumn("ms", F.col("ms") - F.col("ms") % DAY)
    return B.with_ts(M.distinct_in_order(t, ["ms"], "symbol", ["ts", "event_id"])).select("ts", F.array_join("symbols", ",").alias("symbols"))


@query("changed_fields", f"""WITH {TICKS} SELECT {to_ts_sql(f'ms - ms % {DAY}')} AS ts, string_agg(DISTINCT symbol, ', ' ORDER BY symbol) AS fields FROM ticks GROUP BY 1""")
def changed_fields(spark, sf):
    h = inputs.ticks(spark, sf).withColumn("ms", F.col("ms") - F.col("ms") % DAY)
    return B.with_ts(M.changed_fields(h, ["ms"], "symbol")).select("ts", "fields")


@query("open_positions", f"""{TRADES}, lc AS (SELECT symbol, arg_max(close, i) AS last FROM sig GROUP BY symbol)
SELECT symbol, side::int AS side, round(side * (last - entry_price) * qty, 6) AS pnl, round(side * (last - entry_price) / entry_price * 100, 6) AS pct FROM trades JOIN lc USING (symbol) WHERE exit_reason IS NULL""")
def open_positions(spark, sf):
    last = inputs.bars(spark, sf).groupBy("symbol").agg(F.max_by("close", "ms").alias("last"))
    held = booked(spark, sf).filter(F.col("exit_reason").isNull()).join(last, "symbol")
    return rounded(held.withColumn("_p", open_pnl("side", "qty", "entry_price", "last")).select("symbol", "side", "_p.pnl", "_p.pct"))


@query("latest_alerts", f"""WITH a AS (SELECT event_id, ts, value, CASE event_type WHEN 'click' THEN 'trade_open' WHEN 'purchase' THEN 'trade_close' WHEN 'error' THEN 'connection' WHEN 'signup' THEN 'trade_rollover' ELSE 'other' END AS kind FROM events)
SELECT event_id, ts, CASE WHEN kind = 'trade_open' THEN 'open' WHEN kind = 'trade_close' AND value >= 100 THEN 'close_gain' WHEN kind = 'trade_close' THEN 'close_loss' WHEN kind = 'trade_rollover' THEN 'rollover'
 WHEN kind = 'connection' AND event_id % 2 = 0 THEN 'recovery' WHEN kind = 'connection' THEN 'outage' ELSE 'other' END AS category FROM a ORDER BY ts DESC, event_id DESC LIMIT 60""")
def latest_alerts(spark, sf):
    e = inputs.table(spark, sf, "events")
    kind = (F.when(F.col("event_type") == "click", "trade_open").when(F.col("event_type") == "purchase", "trade_close")
            .when(F.col("event_type") == "error", "connection").when(F.col("event_type") == "signup", "trade_rollover").otherwise("other"))
    ok = F.when(F.col("event_id") % 2 == 0, True)
    rows = e.select("event_id", "ts", alert_category(kind, F.col("value") - 100, ok).alias("category"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(60)
