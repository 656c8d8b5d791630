"""Signals, legs, trades, accounts and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import Costs, bracket_exit, limit_touched, maker_fill, position_notional, taker_fill
from tickloom.functions.timeframes import step_ms, to_ts
from tickloom.operators import bars as B
from tickloom.operators import features as FE
from tickloom.operators import labels as L
from tickloom.operators import outcomes as O
from tickloom.plans import inputs
from tickloom.plans.common import SCORED, hashed_sql, indicators_cte, rounded, shared, to_ts_sql
from tickloom.plans.market import STRUCTURE

QUERIES: dict = {}
ORACLE: dict = {}
H1 = step_ms("1h")
DAY = 86_400_000


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


RULES = O.Rules(geometry=L.Geometry(1.5, 2.0, 12), threshold=0.8)
MAKER = O.Rules(geometry=L.Geometry(1.5, 2.0, 12), threshold=0.8, maker_timeout=3)


def scored_bars(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.scored(FE.with_indicators(inputs.bars(spark, sf), "1h"))


def signals(spark: SparkSession, sf: str, threshold: float = 0.8) -> DataFrame:
    """Scored hourly bars with the side each bar asks for."""
    df = shared((spark.sparkContext.applicationId, sf, "scored"), lambda: scored_bars(spark, sf))
    picked = L.stronger_side("p_long", "p_short", threshold)
    return df.withColumn("_s", picked).select("*", F.col("_s.side").alias("side"), F.col("_s.p").alias("p_side")).drop("_s")


BASE = f"{indicators_cte('1h')}, {SCORED}"


def sig_sql(thr: float = 0.8, extra: str = "") -> str:
    return f"""sg AS (SELECT *, CASE WHEN p_short > (CASE WHEN p_long >= {thr}::double THEN p_long ELSE {thr}::double END) THEN -1 WHEN p_long >= {thr}::double THEN 1 ELSE 0 END AS side0,
  lead(open) OVER s AS nopen, max(i) OVER (PARTITION BY symbol) AS last_i FROM scored WINDOW s AS (PARTITION BY symbol ORDER BY i)),
sig AS (SELECT *, CASE WHEN side0 <> 0 AND nopen IS NOT NULL AND atr > 0 THEN side0 ELSE 0 END AS side, CASE WHEN side0 = -1 THEN p_short WHEN side0 = 1 THEN p_long END AS p_side FROM sg)"""


@query("ev_signals", f"""{BASE}, {sig_sql()} SELECT symbol, {to_ts_sql('ms')} AS ts, side0::int AS side, round(p_side, 6) AS p FROM sig WHERE side0 <> 0""")
def ev_signals(spark, sf):
    s = B.with_ts(signals(spark, sf)).filter(F.col("side") != 0)
    return rounded(s.select("symbol", "ts", "side", F.col("p_side").alias("p")))


COST = 0.0024  # 2 * (fee + slippage)
@query("ev_gate_choice", f"""{STRUCTURE}, sc AS (SELECT st.*, scored.p_long, scored.p_short FROM st JOIN (SELECT symbol, i, p_long, p_short FROM (SELECT * FROM scored0)) scored USING (symbol, i)),
o AS (SELECT *, p_long * long_r - (1 - p_long) - {COST}::double / greatest(long_sl_pct, 1e-9) AS ev_l, p_short * short_r - (1 - p_short) - {COST}::double / greatest(short_sl_pct, 1e-9) AS ev_s FROM sc),
g AS (SELECT *, coalesce(p_long >= 0.5 AND long_r >= 1.0 AND ev_l >= 0.1, false) AS okl, coalesce(p_short >= 0.5 AND short_r >= 1.0 AND ev_s >= 0.1, false) AS oks FROM o)
SELECT symbol, {to_ts_sql('ms')} AS ts, (CASE WHEN oks AND (NOT okl OR ev_s > ev_l) THEN -1 ELSE 1 END)::int AS side,
  round(CASE WHEN oks AND (NOT okl OR ev_s > ev_l) THEN ev_s ELSE ev_l END, 6) AS ev FROM g WHERE okl OR oks""".replace("scored0", "sc0").replace(
    ", sc AS", f", sc0 AS ({SCORED[len('scored AS ('):-1]}), sc AS", 1))
def ev_gate_choice(spark, sf):
    st = inputs.scored(L.structure_barriers(FE.with_indicators(inputs.bars(spark, sf), "1h")))
    best = L.best_expected_side(0.5, 1.0, 0.1, COST)
    out = B.with_ts(st.withColumn("_b", best).filter(F.col("_b").isNotNull()))
    return rounded(out.select("symbol", "ts", F.col("_b.side").alias("side"), F.col("_b.ev").alias("ev")))


CONFIGURED = ("view", "click", "error", "purchase", "signup")


@query("topk_per_bar", f"""{BASE}, {sig_sql(0.5)} SELECT {to_ts_sql('ms')} AS ts, rule, symbol, rn, round(p_side, 6) AS p FROM (
  SELECT ms, 'best_first' AS rule, symbol, p_side, row_number() OVER (PARTITION BY ms ORDER BY p_side DESC, symbol)::int AS rn FROM sig WHERE side0 <> 0
  UNION ALL SELECT ms, 'fcfs', symbol, p_side, row_number() OVER (PARTITION BY ms ORDER BY list_position({list(CONFIGURED)}, symbol), symbol)::int FROM sig WHERE side0 <> 0) WHERE rn <= 2""")
def topk_per_bar(spark, sf):
    """The two entries a bar with two free slots takes: by probability, or as they come in the configured order."""
    s = signals(spark, sf, 0.5).filter(F.col("side") != 0)
    place = F.array_position(F.array(*map(F.lit, CONFIGURED)), F.col("symbol"))
    rules = {"best_first": [F.desc("p_side"), F.col("symbol")], "fcfs": [place, F.col("symbol")]}
    tops = [O.top_k_per_bar(s, 2, order).withColumn("rule", F.lit(name)) for name, order in rules.items()]
    return rounded(B.with_ts(tops[0].unionByName(tops[1])).select("ts", "rule", "symbol", "rn", F.col("p_side").alias("p")))


@query("signals_by_p", f"""{BASE}, {sig_sql()} SELECT symbol, {to_ts_sql('ms')} AS ts, round(p_side, 6) AS p FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ms DESC) = 1 ORDER BY p DESC NULLS LAST, symbol""")
def signals_by_p(spark, sf):
    """Each symbol's newest bar, the most probable signal first and bars without a signal last."""
    last = signals(spark, sf).groupBy("symbol").agg(F.max_by(F.struct("ms", F.col("p_side").alias("p")), "ms").alias("_l")).select("symbol", "_l.*")
    return rounded(B.with_ts(last).select("symbol", "ts", "p")).orderBy(F.desc_nulls_last("p"), "symbol")


@query("fill_scalars", f"""{BASE} SELECT symbol, {to_ts_sql('ms')} AS ts, round(open * 1.0002::double, 6) AS buy_price, round(open * 1.0002::double * 3 * 0.001, 6) AS buy_fee, round(open * 0.9998::double, 6) AS sell_price,
 round(close * 3 * 0.0008::double, 6) AS maker_fee, low <= close AS long_touched, high >= open AS short_touched,
 CASE WHEN low <= open - atr THEN 'sl' WHEN high >= open + 1.5 * atr THEN 'tp' END AS long_exit, CASE WHEN high >= open + atr THEN 'sl' WHEN low <= open - 1.5 * atr THEN 'tp' END AS short_exit FROM ind""")
def fill_scalars(spark, sf):
    """The fill, touch and bracket rules applied to every bar."""
    b, costs = FE.with_indicators(inputs.bars(spark, sf), "1h"), Costs(taker_fee=0.001, maker_fee=0.0008, slippage=0.0002)
    buy, sell, rest = taker_fill("open", F.lit(3.0), F.lit(True), costs), taker_fill("open", F.lit(3.0), F.lit(False), costs), maker_fill("close", F.lit(3.0), costs)
    o, a = F.col("open"), F.col("atr")
    exits = lambda side: bracket_exit(F.lit(side), F.col("low"), F.col("high"), o + side * 1.5 * a, o - side * a)
    return rounded(B.with_ts(b).select(
        "symbol", "ts", buy["price"].alias("buy_price"), buy["fee"].alias("buy_fee"), sell["price"].alias("sell_price"), rest["fee"].alias("maker_fee"),
        limit_touched(F.lit(1), "low", "high", "close").alias("long_touched"), limit_touched(F.lit(-1), "low", "high", "open").alias("short_touched"),
        exits(1).alias("long_exit"), exits(-1).alias("short_exit")))


@query("slot_contention", f"""{BASE}, {sig_sql(0.5)}, b AS (SELECT ms, count(*) AS n FROM sig WHERE side0 <> 0 GROUP BY 1)
SELECT count(*) AS bars, sum(n)::bigint AS candidates, count(*) FILTER (n > 2) AS contended_bars, sum(greatest(n - 2, 0))::bigint AS blocked FROM b""")
def slot_contention(spark, sf):
    return O.slot_contention(signals(spark, sf, 0.5).filter(F.col("side") != 0), 2)


# --- legs and chains ---------------------------------------------------------------------------

def leg_sql(thr: float = 0.8, h: int = 12, tp: float = 1.5, sl: float = 2.0, slip: float = 0.0002, rollover: bool = True) -> str:
    """Entry legs (e), roll legs (r) of every bar, by range self-joins."""
    return f"""{sig_sql(thr)},
en AS (SELECT symbol, i, side, CASE WHEN side > 0 THEN nopen * (1 + {slip}::double) ELSE nopen * (1 - {slip}::double) END AS fill, atr, nopen, p_side, last_i FROM sig WHERE side <> 0),
eb AS (SELECT *, fill + side * {tp}::double * atr AS tp, fill - side * {sl}::double * atr AS sl FROM en),
et AS (SELECT e.symbol, e.i, min(CASE WHEN (e.side > 0 AND x.high >= e.tp) OR (e.side < 0 AND x.low <= e.tp) THEN x.i END) AS t, min(CASE WHEN (e.side > 0 AND x.low <= e.sl) OR (e.side < 0 AND x.high >= e.sl) THEN x.i END) AS l
  FROM eb e JOIN sig x ON x.symbol = e.symbol AND x.i BETWEEN e.i + 1 AND e.i + {h + 1} GROUP BY 1, 2),
el AS (SELECT e.*, CASE WHEN l IS NOT NULL AND (t IS NULL OR l <= t) THEN 'sl' WHEN t IS NOT NULL THEN 'tp' WHEN e.i + {h + 1} <= last_i THEN 'timeout' END AS reason,
  CASE WHEN l IS NOT NULL AND (t IS NULL OR l <= t) THEN l WHEN t IS NOT NULL THEN t WHEN e.i + {h + 1} <= last_i THEN e.i + {h + 1} END AS end_i FROM eb e LEFT JOIN et USING (symbol, i)),
ep AS MATERIALIZED (SELECT el.*, CASE reason WHEN 'sl' THEN sl WHEN 'tp' THEN tp ELSE c.close END AS price FROM el LEFT JOIN sig c ON c.symbol = el.symbol AND c.i = el.end_i),
rn AS (SELECT symbol, i, 1 AS side, close, atr, last_i FROM sig WHERE p_long >= {thr}::double AND atr > 0 AND {rollover} UNION ALL SELECT symbol, i, -1, close, atr, last_i FROM sig WHERE p_short >= {thr}::double AND atr > 0 AND {rollover}),
rb AS (SELECT *, close + side * {tp}::double * atr AS tp, close - side * {sl}::double * atr AS sl FROM rn),
rt AS (SELECT e.symbol, e.i, e.side, min(CASE WHEN (e.side > 0 AND x.high >= e.tp) OR (e.side < 0 AND x.low <= e.tp) THEN x.i END) AS t, min(CASE WHEN (e.side > 0 AND x.low <= e.sl) OR (e.side < 0 AND x.high >= e.sl) THEN x.i END) AS l
  FROM rb e JOIN sig x ON x.symbol = e.symbol AND x.i BETWEEN e.i + 1 AND e.i + {h} GROUP BY 1, 2, 3),
rl AS (SELECT e.*, CASE WHEN l IS NOT NULL AND (t IS NULL OR l <= t) THEN 'sl' WHEN t IS NOT NULL THEN 'tp' WHEN e.i + {h} <= last_i THEN 'timeout' END AS reason,
  CASE WHEN l IS NOT NULL AND (t IS NULL OR l <= t) THEN l WHEN t IS NOT NULL THEN t WHEN e.i + {h} <= last_i THEN e.i + {h} END AS end_i FROM rb e LEFT JOIN rt USING (symbol, i, side)),
rp AS MATERIALIZED (SELECT rl.*, CASE reason WHEN 'sl' THEN sl WHEN 'tp' THEN tp ELSE c.close END AS price FROM rl LEFT JOIN sig c ON c.symbol = rl.symbol AND c.i = rl.end_i)"""


def chain_sql(thr: float = 0.8, h: int = 12, tp: float = 1.5, sl: float = 2.0, slip: float = 0.0002, fee: float = 0.001,
              pct: float = 0.1, rollover: bool = True) -> str:
    """Trades of one position per symbol, then the compounding account, by recursive walks."""
    return f"""{leg_sql(thr, h, tp, sl, slip, rollover)},
nx AS MATERIALIZED (SELECT symbol, i AS at_i, (SELECT min(s.i) FROM ep s WHERE s.symbol = a.symbol AND s.i >= a.i) AS sig_i FROM sig a),
ch AS (SELECT ep.symbol, ep.i AS entry_i, ep.side, ep.end_i, ep.reason, ep.price, 0 AS rolls FROM ep JOIN (SELECT symbol, min(i) AS i FROM ep GROUP BY 1) USING (symbol, i)
  UNION ALL
  SELECT c.symbol, CASE WHEN r.i IS NOT NULL THEN c.entry_i ELSE e.i END, CASE WHEN r.i IS NOT NULL THEN c.side ELSE e.side END,
    CASE WHEN r.i IS NOT NULL THEN r.end_i ELSE e.end_i END, CASE WHEN r.i IS NOT NULL THEN r.reason ELSE e.reason END,
    CASE WHEN r.i IS NOT NULL THEN r.price ELSE e.price END, CASE WHEN r.i IS NOT NULL THEN c.rolls + 1 ELSE 0 END
  FROM ch c LEFT JOIN rp r ON c.reason = 'timeout' AND r.symbol = c.symbol AND r.i = c.end_i AND r.side = c.side
  LEFT JOIN nx ON r.i IS NULL AND nx.symbol = c.symbol AND nx.at_i = c.end_i
  LEFT JOIN ep e ON e.symbol = c.symbol AND e.i = nx.sig_i WHERE r.i IS NOT NULL OR e.i IS NOT NULL),
tr0 AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY symbol, entry_i ORDER BY rolls DESC) = 1),
tr1 AS (SELECT t.symbol, t.entry_i, t.side, e.p_side AS prob, s.ms AS signal_ms, f.ms AS entry_ms, e.nopen, e.fill AS entry_price, t.end_i AS exit_i, t.reason AS exit_reason, x.ms AS exit_ms, t.rolls,
  CASE WHEN t.side < 0 THEN t.price * (1 + {slip}::double) ELSE t.price * (1 - {slip}::double) END AS exit_price
  FROM tr0 t JOIN ep e ON e.symbol = t.symbol AND e.i = t.entry_i JOIN sig s ON s.symbol = t.symbol AND s.i = t.entry_i
  JOIN sig f ON f.symbol = t.symbol AND f.i = t.entry_i + 1 LEFT JOIN sig x ON x.symbol = t.symbol AND x.i = t.end_i),
tr2 AS (SELECT *, side * (exit_price - entry_price) AS ug, {fee}::double * (entry_price + exit_price) AS uf, row_number() OVER (PARTITION BY symbol ORDER BY entry_i) AS k FROM tr1),
tr3 AS (SELECT *, coalesce(1 + {pct}::double / nopen * (ug - uf), 1) AS f FROM tr2),
tr4 AS (SELECT *, 10000.0::double * product(f) OVER (PARTITION BY symbol ORDER BY k) / f AS cash_before FROM tr3),
trades AS (SELECT *, cash_before * {pct}::double / nopen AS qty, cash_before * {pct}::double / nopen * uf AS fees, cash_before * {pct}::double / nopen * (ug - uf) AS pnl, cash_before * f AS cash_after,
  (ug - uf) / entry_price AS r, ug / entry_price AS gross_r, uf / entry_price AS cost_r FROM tr4)"""


@query("entry_outcomes", f"""{BASE}, {leg_sql()} SELECT p.symbol, {to_ts_sql('s.ms')} AS ts, p.side::int AS side, round(fill, 6) AS fill_price, p.reason AS reason, (p.end_i - p.i)::int AS step, round(price, 6) AS price
FROM ep p JOIN sig s ON s.symbol = p.symbol AND s.i = p.i""")
def entry_outcomes(spark, sf):
    n = O.legs(signals(spark, sf), RULES).filter(F.col("side") != 0)
    return rounded(B.with_ts(n).select("symbol", "ts", "side", "fill_price", F.col("e_reason").alias("reason"), F.col("e_step").alias("step"), F.col("e_price").alias("price")))


@query("roll_outcomes", f"""{BASE}, {leg_sql()} SELECT p.symbol, {to_ts_sql('s.ms')} AS ts, p.side::int AS side, p.reason AS reason, (p.end_i - p.i)::int AS step, round(price, 6) AS price
FROM rp p JOIN sig s ON s.symbol = p.symbol AND s.i = p.i""")
def roll_outcomes(spark, sf):
    n = O.legs(signals(spark, sf), RULES)
    leg = lambda name, side: F.when(F.col(f"{name}_ok"), F.struct(
        F.lit(side).alias("side"), *[F.col(f"{name}_{c}").alias(c) for c in ("reason", "step", "price")]))
    both = n.withColumn("_leg", F.explode(F.filter(F.array(leg("l", 1), leg("s", -1)), lambda x: x.isNotNull())))
    return rounded(B.with_ts(both).select("symbol", "ts", "_leg.*"))


def trade_columns(t: DataFrame) -> DataFrame:
    return rounded(t.filter(F.col("exit_reason").isNotNull()).select(
        "symbol", "side", "prob", to_ts("entry_ms").alias("entry_time"), to_ts("exit_ms").alias("exit_time"), "entry_price",
        "exit_price", "exit_reason", "rollovers", "qty", "fees", "pnl"))


TRADE_SELECT = f"""SELECT symbol, side::int AS side, round(prob, 6) AS prob, {to_ts_sql('entry_ms')} AS entry_time, {to_ts_sql('exit_ms')} AS exit_time, round(entry_price, 6) AS entry_price,
  round(exit_price, 6) AS exit_price, exit_reason, rolls::bigint AS rollovers, round(qty, 6) AS qty, round(fees, 6) AS fees, round(pnl, 6) + 0.0 AS pnl FROM trades WHERE exit_reason IS NOT NULL"""


def booked(spark, sf, rules: O.Rules = RULES) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, rules)
    return shared(key, lambda: O.evaluate(signals(spark, sf, rules.threshold), rules))


@query("trades_chain", f"{BASE}, {chain_sql()} {TRADE_SELECT}")
def trades_chain(spark, sf):
    return trade_columns(booked(spark, sf))


NO_ROLL = O.Rules(geometry=L.Geometry(1.0, 1.0, 6), threshold=0.7, rollover=False)


@query("trades_no_rollover", f"{BASE}, {chain_sql(0.7, 6, 1.0, 1.0, rollover=False)} {TRADE_SELECT}")
def trades_no_rollover(spark, sf):
    return trade_columns(booked(spark, sf, NO_ROLL))


EQUITY = """eq0 AS (SELECT s.symbol, s.i, s.ms, s.close, t.entry_i, t.side, t.qty, t.entry_price, t.exit_i, t.cash_before, t.cash_after
  FROM sig s LEFT JOIN trades t ON t.symbol = s.symbol AND t.entry_i = (SELECT max(u.entry_i) FROM trades u WHERE u.symbol = s.symbol AND u.entry_i <= s.i)),
eq AS (SELECT symbol, i, ms, close, CASE WHEN entry_i IS NOT NULL AND (exit_i IS NULL OR i < exit_i) THEN cash_before - qty * entry_price - 0.001::double * qty * entry_price ELSE coalesce(cash_after, 10000.0::double) END AS cash,
  CASE WHEN entry_i IS NOT NULL AND (exit_i IS NULL OR i < exit_i) THEN cash_before - 0.001::double * qty * entry_price + side * qty * (close - entry_price) ELSE coalesce(cash_after, 10000.0::double) END AS equity FROM eq0)"""


def equity(spark, sf, rules: O.Rules = RULES) -> DataFrame:
    s = signals(spark, sf, rules.threshold)
    return O.equity_curve(s.select("symbol", "i", "ms", "close"), booked(spark, sf, rules), rules)


@query("trade_equity", f"{BASE}, {chain_sql()}, {EQUITY} SELECT symbol, {to_ts_sql('ms')} AS ts, close, round(equity, 6) AS equity, round(cash, 6) AS cash FROM eq")
def trade_equity(spark, sf):
    return rounded(B.with_ts(equity(spark, sf)).select("symbol", "ts", "close", "equity", "cash"))


@query("maker_trades")
def maker_trades(spark, sf):
    return trade_columns(booked(spark, sf, MAKER))


# --- structure barriers with an expected-value gate --------------------------------------------

GATED = O.Rules(geometry=L.Geometry(horizon=12), threshold=0.5, rollover=False)
EV_SQL = f"""{STRUCTURE}, sc AS (SELECT st.*, {hashed_sql(repr('L'), 'symbol', 'ms')} AS p_long, {hashed_sql(repr('S'), 'symbol', 'ms')} AS p_short FROM st),
o AS (SELECT *, p_long * long_r - (1 - p_long) - {COST}::double / greatest(long_sl_pct, 1e-9) AS ev_l, p_short * short_r - (1 - p_short) - {COST}::double / greatest(short_sl_pct, 1e-9) AS ev_s FROM sc),
g AS (SELECT *, coalesce(p_long >= 0.5 AND long_r >= 1.0 AND ev_l >= 0.1, false) AS okl, coalesce(p_short >= 0.5 AND short_r >= 1.0 AND ev_s >= 0.1, false) AS oks FROM o),
pk AS (SELECT *, CASE WHEN oks AND (NOT okl OR ev_s > ev_l) THEN -1 WHEN okl THEN 1 ELSE 0 END AS side FROM g),
eb AS (SELECT symbol, i, ms, side, entry AS nopen, last_i, entry * (1 + side * 0.0002::double) AS fill, CASE WHEN side > 0 THEN long_tp ELSE short_tp END AS tp, CASE WHEN side > 0 THEN long_sl ELSE short_sl END AS sl,
  least(0.01::double / greatest(CASE WHEN side > 0 THEN long_sl_pct ELSE short_sl_pct END, 1e-9), 0.95) AS frac FROM pk WHERE side <> 0 AND entry IS NOT NULL AND atr > 0),
et AS (SELECT e.symbol, e.i, min(CASE WHEN (e.side > 0 AND x.high >= e.tp) OR (e.side < 0 AND x.low <= e.tp) THEN x.i END) AS t, min(CASE WHEN (e.side > 0 AND x.low <= e.sl) OR (e.side < 0 AND x.high >= e.sl) THEN x.i END) AS l
  FROM eb e JOIN ind x ON x.symbol = e.symbol AND x.i BETWEEN e.i + 1 AND e.i + 13 GROUP BY 1, 2),
el AS (SELECT e.*, CASE WHEN l IS NOT NULL AND (t IS NULL OR l <= t) THEN 'sl' WHEN t IS NOT NULL THEN 'tp' WHEN e.i + 13 <= last_i THEN 'timeout' END AS reason, coalesce(least(l, t), CASE WHEN e.i + 13 <= last_i THEN e.i + 13 END) AS end_i FROM eb e LEFT JOIN et USING (symbol, i)),
ep AS MATERIALIZED (SELECT el.*, c.ms AS exit_ms, CASE reason WHEN 'sl' THEN sl WHEN 'tp' THEN tp ELSE c.close END AS price FROM el LEFT JOIN ind c ON c.symbol = el.symbol AND c.i = el.end_i),
nx AS MATERIALIZED (SELECT a.symbol, a.i, (SELECT min(s.i) FROM ep s WHERE s.symbol = a.symbol AND s.i >= a.end_i) AS nxt FROM ep a),
ch AS (SELECT symbol, min(i) AS i FROM ep GROUP BY 1 UNION ALL SELECT c.symbol, nx.nxt FROM ch c JOIN nx USING (symbol, i) WHERE nx.nxt IS NOT NULL),
m AS (SELECT ep.*, price * (1 - side * 0.0002::double) AS px, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM ch JOIN ep USING (symbol, i)),
mf AS (SELECT *, coalesce(1 + frac / nopen * (side * (px - fill) - 0.001::double * (fill + px)), 1) AS f FROM m),
mc AS (SELECT *, 10000.0::double * product(f) OVER (PARTITION BY symbol ORDER BY k) / f AS cash FROM mf)"""


@query("structure_trades", f"""{EV_SQL} SELECT symbol, side::int AS side, {to_ts_sql('ms')} AS entry_time, {to_ts_sql('exit_ms')} AS exit_time, reason AS exit_reason, round(cash * frac / nopen, 6) AS qty, round(fill, 6) AS entry_price, round(px, 6) AS exit_price,
 round(cash * (f - 1), 4) + 0.0 AS pnl FROM mc WHERE reason IS NOT NULL""")
def structure_trades(spark, sf):
    """Entries behind an expected-value gate, sized so that a stop costs one percent of cash."""
    scored = shared((spark.sparkContext.applicationId, sf, "scored"), lambda: scored_bars(spark, sf))
    st = L.structure_barriers(scored).withColumn("_b", L.best_expected_side(0.5, 1.0, 0.1, COST))
    is_long = F.col("_b.side") > 0
    st = st.withColumns({
        "side": F.coalesce(F.col("_b.side"), F.lit(0)), "p_side": F.col("_b.p"),
        "tp_price": F.when(is_long, F.col("long_tp")).otherwise(F.col("short_tp")),
        "sl_price": F.when(is_long, F.col("long_sl")).otherwise(F.col("short_sl")),
        "fraction": position_notional(F.lit(1.0), F.col("_b.sl_pct"), 0.1, risk_pct=0.01),
    })
    rows = st.select("symbol", "i", "ms", "open", "high", "low", "close", "atr", "p_long", "p_short", "side", "p_side", "tp_price", "sl_price", "fraction")
    t = O.evaluate(rows, GATED).filter(F.col("exit_reason").isNotNull()).withColumn("pnl", F.round("pnl", 4) + F.lit(0.0))
    return rounded(t.select("symbol", "side", to_ts("signal_ms").alias("entry_time"), to_ts("exit_ms").alias("exit_time"), "exit_reason",
                            "qty", "entry_price", "exit_price", "pnl"), skip=("pnl",))


@query("universe_caps", f"""{BASE}, {sig_sql(0.5)}, cp AS (SELECT * FROM range(1, 4) a(cap), (VALUES ('all'), ('narrow')) b(universe)), b AS (SELECT cap, universe, ms, count(*) AS n FROM sig, cp WHERE side0 <> 0 AND (universe = 'all' OR symbol IN ('click', 'view', 'error')) GROUP BY ALL)
SELECT universe, cap::int AS cap, sum(n)::bigint AS candidates, sum(least(n, cap))::bigint AS served, count(*) FILTER (n > cap) AS contended_bars FROM b GROUP BY ALL""")
def universe_caps(spark, sf):
    """How often each board width asks for more positions than each cap allows (static view)."""
    s = signals(spark, sf, 0.5).filter(F.col("side") != 0)
    wide = s.withColumn("universe", F.explode(F.when(F.col("symbol").isin("click", "view", "error"), F.array(F.lit("all"), F.lit("narrow"))).otherwise(F.array(F.lit("all")))))
    per_bar = wide.groupBy("universe", "ms").agg(F.count(F.lit(1)).alias("n"))
    grid = per_bar.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in (1, 2, 3)])))
    return grid.groupBy("universe", "cap").agg(
        F.sum("n").alias("candidates"), F.sum(F.least(F.col("n"), F.col("cap").cast("long"))).alias("served"), F.count_if(F.col("n") > F.col("cap")).alias("contended_bars"))


@query("live_outcomes", f"""{BASE}, {sig_sql()}, eb AS (SELECT symbol, i, ms, side, last_i, close * (1 + side * 0.0002::double) AS fill, close * (1 + side * 0.0002::double) + side * 1.5::double * atr AS tp, close * (1 + side * 0.0002::double) - side * 2.0::double * atr AS sl FROM sig WHERE side <> 0),
et AS (SELECT e.symbol, e.i, min(CASE WHEN (e.side > 0 AND x.high >= e.tp) OR (e.side < 0 AND x.low <= e.tp) THEN x.i END) AS t, min(CASE WHEN (e.side > 0 AND x.low <= e.sl) OR (e.side < 0 AND x.high >= e.sl) THEN x.i END) AS l FROM eb e JOIN sig x ON x.symbol = e.symbol AND x.i BETWEEN e.i + 1 AND e.i + 12 GROUP BY 1, 2)
SELECT symbol, {to_ts_sql('ms')} AS ts, side::int AS side, CASE WHEN l IS NOT NULL AND (t IS NULL OR l <= t) THEN 'sl' WHEN t IS NOT NULL THEN 'tp' WHEN i + 12 <= last_i THEN 'timeout' END AS reason,
 (coalesce(least(l, t), CASE WHEN i + 12 <= last_i THEN i + 12 END) - i)::int AS step FROM eb LEFT JOIN et USING (symbol, i)""")
def live_outcomes(spark, sf):
    rules = O.Rules(geometry=L.Geometry(1.5, 2.0, 12), threshold=0.8, hold="live")
    n = O.legs(signals(spark, sf), rules).filter(F.col("side") != 0)
    return B.with_ts(n).select("symbol", "ts", "side", F.col("e_reason").alias("reason"), F.col("e_step").alias("step"))
