"""Bars, hygiene, features and labels over the tick table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import candle_parts, perpetual_symbol, path_safe
from tickloom.functions.timeframes import step_ms, to_ts
from tickloom.operators import bars as B
from tickloom.operators import features as FE
from tickloom.operators import labels as L
from tickloom.operators.asof import asof_backward
from tickloom.operators.chunking import drop_halo, number_on_grid, running, with_halo
from tickloom.operators.rolling import log_return, rolling, rolling_z
from tickloom.plans import inputs
from tickloom.plans.common import (
    NUMBERED, TICKS, bars_cte, indicators_cte, rounded, to_ts_sql,
)

H1 = step_ms("1h")
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


BASE = f"WITH {TICKS}, {bars_cte('1h')}"
BASE_N = f"{BASE}, {NUMBERED}"
W_SYM = "WINDOW s AS (PARTITION BY symbol ORDER BY ms)"


@query("bars_overview", f"""{BASE}, r AS (
  SELECT symbol, ms, close, volume, ln(close) - ln(lag(close) OVER s) AS ret_1, close / max(close) OVER s - 1 AS drawdown FROM bars {W_SYM})
SELECT symbol, {to_ts_sql('ms')} AS ts, close, volume, round(ret_1, 6) + 0.0 AS ret_1,
  round(CASE WHEN count(ret_1) OVER f = 15 THEN stddev_samp(ret_1) OVER f END, 6) + 0.0 AS vol_15, round(drawdown, 6) + 0.0 AS drawdown
FROM r WINDOW f AS (PARTITION BY symbol ORDER BY ms ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def bars_overview(spark: SparkSession, sf: str) -> DataFrame:
    numbered = number_on_grid(inputs.bars(spark, sf).select("symbol", "ms", "close", "volume"), ["symbol"], H1)
    rows, w = with_halo(numbered, ["symbol"], back=16)
    rows = rows.withColumn("ret_1", log_return(w, 1))
    rows = drop_halo(rows.withColumn("vol_15", rolling(w, 15, "std", "ret_1")))
    peak = running(rows, ["symbol"], {"peak": ("max", F.col("close"))})
    out = peak.withColumn("drawdown", F.col("close") / F.col("peak") - 1)
    return rounded(B.with_ts(out).select("symbol", "ts", "close", "volume", "ret_1", "vol_15", "drawdown"))


for _tf, _name in (("1m", "bars_minute"), ("1h", "bars_hourly"), ("1d", "bars_daily")):
    def _bars(spark, sf, tf=_tf):
        return B.with_ts(inputs.bars(spark, sf, tf)).drop("ms")
    query(_name, f"WITH {TICKS}, {bars_cte(_tf)} SELECT symbol, {to_ts_sql('ms')} AS ts, open, high, low, close, volume FROM bars")(_bars)


@query("bars_resample_4h", f"""{BASE} SELECT symbol, {to_ts_sql('ms - ms % 14400000')} AS ts, arg_min(open, ms) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, ms) AS close, sum(volume)::bigint AS volume FROM bars GROUP BY ALL""")
def bars_resample_4h(spark, sf):
    return B.with_ts(B.resample(inputs.bars(spark, sf), "4h")).drop("ms")


def sparse_bars(spark, sf, tf="15m"):
    return inputs.bars(spark, sf, tf)


@query("gaps", f"""WITH {TICKS}, {bars_cte('15m')}, g AS (SELECT symbol, ms, lag(ms) OVER s AS prev FROM bars {W_SYM})
SELECT symbol, {to_ts_sql('prev')} AS gap_start, {to_ts_sql('ms')} AS gap_end, ((ms - prev) // 900000 - 1)::bigint AS missing
FROM g WHERE ms - prev > 900000""")
def gaps(spark, sf):
    return B.gaps(sparse_bars(spark, sf), "15m")


NOW_MS = 1705338000000  # 2024-01-15 17:00 UTC, a point inside the tick data


@query("closed_bars", f"{BASE} SELECT symbol, {to_ts_sql('ms')} AS ts, close FROM bars WHERE ms < {NOW_MS + 1800000} - ({NOW_MS + 1800000} % 3600000)")
def closed_bars(spark, sf):
    return B.with_ts(B.closed_bars(inputs.bars(spark, sf), "1h", NOW_MS + 1_800_000)).select("symbol", "ts", "close")


@query("merge_upsert", f"""{BASE}, stored AS (SELECT symbol, ms, close FROM bars WHERE ms < {NOW_MS}),
incoming AS (SELECT symbol, ms, close + 1000 AS close FROM bars WHERE ms >= {NOW_MS} - 86400000),
u AS (SELECT *, 0 AS prio FROM stored UNION ALL SELECT *, 1 FROM incoming)
SELECT symbol, {to_ts_sql('ms')} AS ts, close FROM u QUALIFY row_number() OVER (PARTITION BY symbol, ms ORDER BY prio) = 1""")
def merge_upsert(spark, sf):
    b = inputs.bars(spark, sf).select("symbol", "ms", "close")
    stored = b.filter(F.col("ms") < NOW_MS)
    incoming = b.filter(F.col("ms") >= NOW_MS - 86_400_000).withColumn("close", F.col("close") + 1000)
    return B.with_ts(B.merge_keep_existing(stored, incoming)).select("symbol", "ts", "close")


@query("fetch_ranges", f"""{BASE}, want AS (SELECT DISTINCT symbol FROM ticks UNION ALL SELECT 'unlisted'),
have AS (SELECT symbol, min(ms) AS lo, max(ms) AS hi FROM bars WHERE ms < {NOW_MS} GROUP BY 1),
j AS (SELECT w.symbol, lo, hi FROM want w LEFT JOIN have USING (symbol)),
r AS (SELECT symbol, 'cold' AS kind, {NOW_MS} - 30::bigint * 86400000 AS f, {NOW_MS} AS t FROM j WHERE lo IS NULL
 UNION ALL SELECT symbol, 'backfill', {NOW_MS} - 30::bigint * 86400000, lo FROM j WHERE lo > {NOW_MS} - 30::bigint * 86400000
 UNION ALL SELECT symbol, 'forward', hi + 3600000, {NOW_MS} FROM j WHERE hi + 3600000 < {NOW_MS})
SELECT symbol, kind, {to_ts_sql('f')} AS from_ts, {to_ts_sql('t')} AS to_ts FROM r""")
def fetch_ranges(spark, sf):
    b = inputs.bars(spark, sf).filter(F.col("ms") < NOW_MS)
    symbols = inputs.ticks(spark, sf).select("symbol").distinct()
    wanted = symbols.unionByName(spark.range(1).select(F.lit("unlisted").alias("symbol")))
    plan = B.fetch_ranges(wanted, b, "1h", F.lit(NOW_MS), days=30)
    return plan.select("symbol", "kind", to_ts("from_ms").alias("from_ts"), to_ts("to_ms").alias("to_ts"))


@query("raw_arrays", f"""{BASE} SELECT symbol, {to_ts_sql('ms')} AS ts, open, high, low, close, volume::double AS volume FROM bars""")
def raw_arrays(spark, sf):
    b = inputs.bars(spark, sf)
    day = F.floor(F.col("ms") / 86_400_000)
    row = F.array(*[F.col(c).cast("double") for c in ("ms", *B.OHLCV)])
    pages = b.groupBy("symbol", day.alias("page")).agg(F.collect_list(row).alias("rows"))
    return B.with_ts(B.decode_raw(pages)).drop("ms")


@query("tail_rows", f"""{BASE} SELECT symbol, {to_ts_sql('ms')} AS ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ms DESC) <= 200""")
def tail_rows(spark, sf):
    return B.with_ts(B.tail(inputs.bars(spark, sf), 200)).select("symbol", "ts", "close")


@query("span_per_symbol", f"""{BASE} SELECT symbol, count(*) AS bars, {to_ts_sql('min(ms)')} AS first_ts, {to_ts_sql('max(ms)')} AS last_ts,
  round(avg((close > open)::int), 6) AS base_rate FROM bars GROUP BY symbol""")
def span_per_symbol(spark, sf):
    b = inputs.bars(spark, sf)
    return rounded(b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), to_ts(F.min("ms")).alias("first_ts"), to_ts(F.max("ms")).alias("last_ts"),
        F.avg((F.col("close") > F.col("open")).cast("int")).alias("base_rate"),
    ))


# --- as-of -------------------------------------------------------------------------------------

RATES = """sym AS (SELECT DISTINCT symbol FROM ticks),
rates AS (SELECT symbol, ms, rate FROM (SELECT epoch_us(ts) // 1000 AS ms, max(value / 100000.0::double) AS rate FROM events
  WHERE event_type = 'signup' AND event_id % 7 = 0 GROUP BY 1) CROSS JOIN sym)"""


@query("asof_rates", f"""{BASE}, {RATES}
SELECT b.symbol, {to_ts_sql('b.ms')} AS ts, b.close, r.rate FROM bars b ASOF LEFT JOIN rates r ON b.symbol = r.symbol AND b.ms >= r.ms""")
def asof_rates(spark, sf):
    b = inputs.bars(spark, sf).select("symbol", "ms", "close")
    return B.with_ts(asof_backward(b, inputs.rates(spark, sf), ["symbol"], ["rate"], grid_ms=H1)).drop("ms")


@query("asof_ticks", f"""WITH {TICKS}, {RATES}
SELECT t.symbol, t.event_id, t.ts, t.price, r.rate FROM ticks t ASOF LEFT JOIN rates r ON t.symbol = r.symbol AND t.ms >= r.ms""")
def asof_ticks(spark, sf):
    return asof_backward(inputs.ticks(spark, sf), inputs.rates(spark, sf), ["symbol"], ["rate"]).drop("ms")


@query("rates_features", f"""{BASE}, {RATES}, f AS (SELECT symbol, ms, rate, count(*) OVER w AS n, avg(rate) OVER w AS m, stddev_samp(rate) OVER w AS sd, sum(rate) OVER w AS c
  FROM rates WINDOW w AS (PARTITION BY symbol ORDER BY ms ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
g AS (SELECT symbol, ms, rate AS funding_now, CASE WHEN n = 9 THEN m END AS funding_mean9,
  CASE WHEN n = 9 THEN (rate - m) / nullif(sd, 0) END AS funding_z, CASE WHEN n = 9 THEN c END AS funding_cum9 FROM f)
SELECT b.symbol, {to_ts_sql('b.ms')} AS ts, round(funding_now, 8) + 0.0 AS funding_now, round(funding_mean9, 8) + 0.0 AS funding_mean9,
 round(funding_z, 6) + 0.0 AS funding_z, round(funding_cum9, 8) + 0.0 AS funding_cum9
FROM bars b ASOF LEFT JOIN g ON b.symbol = g.symbol AND b.ms >= g.ms""")
def rates_features(spark, sf):
    b = inputs.bars(spark, sf).select("symbol", "ms")
    joined = asof_backward(b, FE.rate_features(inputs.rates(spark, sf)), ["symbol"], FE.RATE_FEATURE_COLUMNS, grid_ms=H1)
    out = B.with_ts(joined).select("symbol", "ts", *FE.RATE_FEATURE_COLUMNS)
    small = ("funding_now", "funding_mean9", "funding_cum9")
    return rounded(out.withColumns({c: F.round(c, 8) + F.lit(0.0) for c in small}), 6, skip=small)


# --- windows -----------------------------------------------------------------------------------

def _windowed(spark, sf, back, columns):
    rows, w = with_halo(number_on_grid(inputs.bars(spark, sf), ["symbol"], H1), ["symbol"], back=back)
    for stage in columns(w):
        rows = rows.withColumns(stage)
    return B.with_ts(drop_halo(rows))


_LAGS = (1, 3, 5, 15, 30, 60, 42, 180)


@query("returns_multi", f"{BASE} SELECT symbol, {to_ts_sql('ms')} AS ts, " + ", ".join(
    f"round(ln(close) - ln(lag(close, {k}) OVER s), 6) + 0.0 AS ret_{k}" for k in _LAGS) + f" FROM bars {W_SYM}")
def returns_multi(spark, sf):
    out = _windowed(spark, sf, 180, lambda w: [{f"ret_{k}": log_return(w, k) for k in _LAGS}])
    return rounded(out.select("symbol", "ts", *[f"ret_{k}" for k in _LAGS]))


def _guard(n: int, agg: str, col: str, w: str) -> str:
    return f"CASE WHEN count({col}) OVER {w} = {n} THEN {agg}({col}) OVER {w} END"


def _frames(*ns: int) -> str:
    return "WINDOW " + ", ".join(f"f{n} AS (PARTITION BY symbol ORDER BY ms ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns)


@query("rolling_vol", f"""{BASE}, r AS (SELECT *, ln(close) - ln(lag(close) OVER s) AS ret FROM bars {W_SYM})
SELECT symbol, {to_ts_sql('ms')} AS ts, """ + ", ".join(f"round({_guard(n, 'stddev_samp', 'ret', f'f{n}')}, 6) + 0.0 AS vol_{n}" for n in (15, 42, 60, 180))
    + f" FROM r {_frames(15, 42, 60, 180)}")
def rolling_vol(spark, sf):
    out = _windowed(spark, sf, 181, lambda w: [
        {"ret": log_return(w, 1)}, {f"vol_{n}": rolling(w, n, "std", "ret") for n in (15, 42, 60, 180)}])
    return rounded(out.select("symbol", "ts", *[f"vol_{n}" for n in (15, 42, 60, 180)]))


@query("rolling_stats", f"""{BASE} SELECT symbol, {to_ts_sql('ms')} AS ts,
round({_guard(42, 'avg', 'close', 'f42')}, 6) + 0.0 AS sma_42, round({_guard(60, 'max', 'high', 'f60')}, 6) + 0.0 AS high_60,
round({_guard(12, 'min', 'low', 'f12')}, 6) + 0.0 AS low_12, round({_guard(12, 'sum', 'volume', 'f12')}::double, 6) + 0.0 AS volume_12,
round((volume - {_guard(60, 'avg', 'volume', 'f60')}) / nullif({_guard(60, 'stddev_samp', 'volume', 'f60')}, 0), 6) + 0.0 AS volume_z
FROM bars {_frames(12, 42, 60)}""")
def rolling_stats(spark, sf):
    out = _windowed(spark, sf, 60, lambda w: [{
        "sma_42": rolling(w, 42, "mean", "close"), "high_60": rolling(w, 60, "max", "high"),
        "low_12": rolling(w, 12, "min", "low"), "volume_12": rolling(w, 12, "sum", "volume").cast("double"),
        "volume_z": rolling_z(w, 60, "volume")}])
    return rounded(out.select("symbol", "ts", "sma_42", "high_60", "low_12", "volume_12", "volume_z"))


@query("calendar_and_shape", f"""{BASE} SELECT symbol, {to_ts_sql('ms')} AS ts,
round(sin(2 * pi() * (hour({to_ts_sql('ms')}) + minute({to_ts_sql('ms')}) / 60.0::double) / 24.0), 6) + 0.0 AS hour_sin,
round(cos(2 * pi() * (hour({to_ts_sql('ms')}) + minute({to_ts_sql('ms')}) / 60.0::double) / 24.0), 6) + 0.0 AS hour_cos,
(isodow({to_ts_sql('ms')}) - 1)::double AS dow, round((high - low) / close, 6) + 0.0 AS range_norm, round((close - open) / nullif(high - low, 0), 6) + 0.0 AS body_ratio
FROM bars""")
def calendar_and_shape(spark, sf):
    b = B.with_ts(inputs.bars(spark, sf))
    return rounded(b.select("symbol", "ts", *candle_parts("ts")))


@query("lead_entry", f"{BASE} SELECT symbol, {to_ts_sql('ms')} AS ts, lead(open) OVER s AS entry FROM bars {W_SYM}")
def lead_entry(spark, sf):
    rows, w = with_halo(number_on_grid(inputs.bars(spark, sf), ["symbol"], H1), ["symbol"], back=0, ahead=1)
    return B.with_ts(drop_halo(rows.withColumn("entry", F.lead("open").over(w)))).select("symbol", "ts", "entry")


@query("symbol_names", """SELECT DISTINCT event_type AS symbol, event_type || '/USD:USD' AS perpetual, event_type || '-USD_USD' AS file_key FROM events""")
def symbol_names(spark, sf):
    pair = F.concat("event_type", F.lit("/USD"))
    events = inputs.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), pair.alias("pair")).distinct()
    return events.select("symbol", perpetual_symbol("pair").alias("perpetual"), path_safe(perpetual_symbol("pair")).alias("file_key"))


# --- exponential means and the feature table ---------------------------------------------------

IND = indicators_cte("1h")


@query("ema_family", f"{IND} SELECT symbol, {to_ts_sql('ms')} AS ts, round(ema9, 6) AS ema9, round(ema21, 6) AS ema21, round(ema50, 6) AS ema50 FROM ind")
def ema_family(spark, sf):
    return rounded(B.with_ts(FE.with_indicators(inputs.bars(spark, sf), "1h", ema=True)).select("symbol", "ts", "ema9", "ema21", "ema50"))


@query("atr_wilder", f"{IND} SELECT symbol, {to_ts_sql('ms')} AS ts, round(atr, 6) AS atr FROM ind")
def atr_wilder(spark, sf):
    return rounded(B.with_ts(FE.with_indicators(inputs.bars(spark, sf), "1h")).select("symbol", "ts", "atr"))


@query("rsi_wilder", f"{IND} SELECT symbol, {to_ts_sql('ms')} AS ts, round(rsi, 6) AS rsi FROM ind")
def rsi_wilder(spark, sf):
    return rounded(B.with_ts(FE.with_indicators(inputs.bars(spark, sf), "1h", rsi_period=14)).select("symbol", "ts", "rsi"))


def _feature_sql(extra: str = "", join: str = "", more: str = "") -> str:
    g = _guard
    return f"""{IND}{more}, f AS (SELECT *, ln(close) - ln(lag(close) OVER s) AS ret_1, (high - low) / nullif(close, 0) AS range_norm,
  {", ".join(f"ln(close) - ln(lag(close, {k}) OVER s) AS ret_{k}" for k in (3, 5, 15, 30, 60))},
  ln(close) - ln(lag(close, 42) OVER s) AS mom_42, ln(close) - ln(lag(close, 180) OVER s) AS mom_180 FROM ind {W_SYM}),
g AS (SELECT *, {g(15, 'stddev_samp', 'ret_1', 'f15')} AS vol_15, {g(60, 'stddev_samp', 'ret_1', 'f60')} AS vol_60,
  {g(42, 'stddev_samp', 'ret_1', 'f42')} AS v42, {g(180, 'stddev_samp', 'ret_1', 'f180')} AS v180,
  (volume - {g(60, 'avg', 'volume', 'f60')}) / nullif({g(60, 'stddev_samp', 'volume', 'f60')}, 0) AS volume_z,
  {g(15, 'avg', 'range_norm', 'f15')} AS range_norm_15, close / {g(42, 'avg', 'close', 'f42')} - 1 AS trend_42,
  close / {g(180, 'avg', 'close', 'f180')} - 1 AS trend_180, close / {g(180, 'max', 'close', 'f180')} - 1 AS dd_180,
  2 * pi() * (hour({to_ts_sql('ms')}) + minute({to_ts_sql('ms')}) / 60.0::double) / 24.0 AS angle
  FROM f {_frames(15, 42, 60, 180)}),
h AS (SELECT symbol, ms, i, atr, {", ".join(f"ret_{k}" for k in (1, 3, 5, 15, 30, 60))}, vol_15, vol_60, vol_15 / nullif(vol_60, 0) AS vol_ratio, rsi AS rsi_14,
  atr / close AS atr_norm, ema9 / ema21 - 1 AS ema_9_21, close / ema50 - 1 AS close_ema50, volume_z, range_norm, range_norm_15,
  (close - open) / nullif(high - low, 0) AS body_ratio, sin(angle) AS hour_sin, cos(angle) AS hour_cos, (isodow({to_ts_sql('ms')}) - 1)::double AS dow,
  trend_42, trend_180, mom_42, mom_180, v42 / nullif(v180, 0) AS vol_regime, dd_180 FROM g)
SELECT h.symbol, {to_ts_sql('h.ms')} AS ts, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FE.FEATURE_COLUMNS)}{extra} FROM h{join}"""


@query("feature_table", _feature_sql())
def feature_table(spark, sf):
    out = B.with_ts(FE.compute_features(inputs.bars(spark, sf), "1h"))
    return rounded(out.select("symbol", "ts", *FE.FEATURE_COLUMNS))


@query("feature_table_rates", _feature_sql(
    ", round(rate, 8) + 0.0 AS funding_now", " ASOF LEFT JOIN rates r ON h.symbol = r.symbol AND h.ms >= r.ms", f", {RATES}"))
def feature_table_rates(spark, sf):
    out = B.with_ts(FE.compute_features(inputs.bars(spark, sf), "1h", rates=inputs.rates(spark, sf)))
    out = out.select("symbol", "ts", *FE.FEATURE_COLUMNS, (F.round("funding_now", 8) + F.lit(0.0)).alias("funding_now"))
    return rounded(out, skip=("funding_now",))


@query("complete_features", f"SELECT symbol, count(*) AS complete_rows FROM ({_feature_sql()}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FE.FEATURE_COLUMNS) + " GROUP BY symbol")
def complete_features(spark, sf):
    out = FE.compute_features(inputs.bars(spark, sf), "1h")
    return FE.complete_rows(out, FE.FEATURE_COLUMNS).groupBy("symbol").agg(F.count(F.lit(1)).alias("complete_rows"))


# --- labels ------------------------------------------------------------------------------------

def _label_sql(direction: str, h: int = 24, tp: float = 1.5, sl: float = 2.0) -> str:
    s = 1 if direction == "long" else -1
    tp_hit, sl_hit = ("x.high >= b.tp", "x.low <= b.sl") if s > 0 else ("x.low <= b.tp", "x.high >= b.sl")
    return f"""{IND}, e AS (SELECT *, lead(open) OVER s AS entry, max(i) OVER (PARTITION BY symbol) AS last_i FROM ind {W_SYM}),
b AS (SELECT *, entry + {s} * {tp}::double * atr AS tp, entry - {s} * {sl}::double * atr AS sl FROM e),
t AS (SELECT b.symbol, b.i, min(CASE WHEN {tp_hit} THEN x.i - b.i - 1 END) AS ft, min(CASE WHEN {sl_hit} THEN x.i - b.i - 1 END) AS fs
  FROM b JOIN ind x ON x.symbol = b.symbol AND x.i BETWEEN b.i + 1 AND b.i + {h} GROUP BY 1, 2),
j AS (SELECT b.*, ft, fs, coalesce(ft < fs, ft IS NOT NULL) AS won FROM b LEFT JOIN t USING (symbol, i))
SELECT symbol, {to_ts_sql('ms')} AS ts, CASE WHEN i + {h + 1} <= last_i AND tp IS NOT NULL AND sl IS NOT NULL AND atr > 0 THEN won::int END AS label, entry,
 round(tp, 6) AS tp, round(sl, 6) AS sl, (CASE WHEN won THEN ft ELSE fs END)::int AS hit_step FROM j"""


for _dir in ("long", "short"):
    def _labels(spark, sf, d=_dir):
        ind = FE.with_indicators(inputs.bars(spark, sf), "1h")
        out = B.with_ts(L.triple_barrier_labels(ind, L.Geometry(), d))
        return rounded(out.select("symbol", "ts", "label", "entry", "tp", "sl", "hit_step"))
    query(f"labels_{_dir}", _label_sql(_dir))(_labels)

STRUCTURE = f"""{IND}, e AS (SELECT *, lead(open) OVER s AS entry, max(i) OVER (PARTITION BY symbol) AS last_i,
  {_guard(12, 'min', 'low', 'f12')} AS sw_lo, {_guard(12, 'max', 'high', 'f12')} AS sw_hi, {_guard(60, 'max', 'high', 'f60')} AS lv_hi, {_guard(60, 'min', 'low', 'f60')} AS lv_lo
  FROM ind {_frames(12, 60)}, s AS (PARTITION BY symbol ORDER BY ms)),
d AS (SELECT *, CASE WHEN atr IS NOT NULL THEN entry - sw_lo END AS a, CASE WHEN atr IS NOT NULL THEN sw_hi - entry END AS c,
  CASE WHEN lv_hi - entry <= 0.5 * atr THEN 2.0 * atr ELSE lv_hi - entry END AS u, CASE WHEN entry - lv_lo <= 0.5 * atr THEN 2.0 * atr ELSE entry - lv_lo END AS v FROM e),
k AS (SELECT *, CASE WHEN a IS NOT NULL THEN least(greatest(a, atr * 0.5), atr * 4.0) END AS l_sl, CASE WHEN c IS NOT NULL THEN least(greatest(c, atr * 0.5), atr * 4.0) END AS s_sl,
  CASE WHEN u IS NOT NULL AND atr IS NOT NULL THEN least(greatest(u, atr * 0.5), atr * 8.0) END AS l_tp, CASE WHEN v IS NOT NULL AND atr IS NOT NULL THEN least(greatest(v, atr * 0.5), atr * 8.0) END AS s_tp FROM d),
st AS (SELECT *, entry + l_tp AS long_tp, entry - l_sl AS long_sl, l_tp / nullif(l_sl, 0) AS long_r, l_sl / entry AS long_sl_pct,
  entry - s_tp AS short_tp, entry + s_sl AS short_sl, s_tp / nullif(s_sl, 0) AS short_r, s_sl / entry AS short_sl_pct FROM k)"""
_ST = ("long_tp", "long_sl", "long_r", "long_sl_pct", "short_tp", "short_sl", "short_r", "short_sl_pct")


def structured(spark, sf):
    return L.structure_barriers(FE.with_indicators(inputs.bars(spark, sf), "1h"))


@query("structure_levels", f"{STRUCTURE} SELECT symbol, {to_ts_sql('ms')} AS ts, entry, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _ST) + " FROM st")
def structure_levels(spark, sf):
    return rounded(B.with_ts(structured(spark, sf)).select("symbol", "ts", "entry", *_ST))


@query("labels_structure", f"""{STRUCTURE}, sd AS (SELECT *, 'long' AS side, long_tp AS tp, long_sl AS sl FROM st UNION ALL SELECT *, 'short', short_tp, short_sl FROM st),
t AS (SELECT b.symbol, b.i, b.side, min(CASE WHEN (side = 'long' AND x.high >= b.tp) OR (side = 'short' AND x.low <= b.tp) THEN x.i - b.i - 1 END) AS ft,
  min(CASE WHEN (side = 'long' AND x.low <= b.sl) OR (side = 'short' AND x.high >= b.sl) THEN x.i - b.i - 1 END) AS fs
  FROM sd b JOIN ind x ON x.symbol = b.symbol AND x.i BETWEEN b.i + 1 AND b.i + 24 GROUP BY 1, 2, 3)
SELECT sd.symbol, side, {to_ts_sql('ms')} AS ts, CASE WHEN sd.i + 25 <= last_i AND tp IS NOT NULL AND sl IS NOT NULL THEN coalesce(ft < fs, ft IS NOT NULL)::int END AS label,
 (CASE WHEN coalesce(ft < fs, ft IS NOT NULL) THEN ft ELSE fs END)::int AS hit_step FROM sd LEFT JOIN t USING (symbol, i, side)""")
def labels_structure(spark, sf):
    sides = [L.barrier_labels(structured(spark, sf), 24, side, f"{side}_tp", f"{side}_sl").withColumn("side", F.lit(side)).select("symbol", "side", "ms", "label", "hit_step")
             for side in ("long", "short")]
    return B.with_ts(sides[0].unionByName(sides[1])).select("symbol", "side", "ts", "label", "hit_step")


@query("label_base_rate", f"SELECT symbol, count(label) AS labelled, round(avg(label), 6) AS base_rate, round(avg(hit_step), 6) AS mean_hit_step FROM ({_label_sql('long')}) GROUP BY symbol")
def label_base_rate(spark, sf):
    out = L.triple_barrier_labels(FE.with_indicators(inputs.bars(spark, sf), "1h"), L.Geometry(), "long")
    return rounded(out.groupBy("symbol").agg(
        F.count("label").alias("labelled"), F.avg("label").alias("base_rate"), F.avg("hit_step").alias("mean_hit_step")))
