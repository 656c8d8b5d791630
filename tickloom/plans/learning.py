"""Walk-forward folds, fold metrics, windows and model training on the labelled bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.timeframes import to_ts
from tickloom.operators import features as FE
from tickloom.operators import labels as L
from tickloom.operators import ml
from tickloom.operators.chunking import number_on_grid
from tickloom.operators.features import FEATURE_COLUMNS
from tickloom.plans import inputs
from tickloom.plans.common import NUMBERED, SCORED, TICKS, bars_cte, hashed_sql, rounded, shared, to_ts_sql
from tickloom.plans.market import _feature_sql, _label_sql
from tickloom.plans.streams import scratch
from tickloom.plans.trading import scored_bars
from tickloom.session import durable

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


_BODY = _label_sql("long", 12)
_HEAD, _TAIL = _BODY.rsplit("SELECT symbol, ", 1)
LAB = f"{_HEAD.rstrip()}, {SCORED}, la AS (SELECT symbol, ms, {_TAIL}), rows AS (SELECT la.symbol, la.ms, label, p_long AS p FROM la JOIN scored USING (symbol, ms) WHERE label IS NOT NULL)"
FOLDS = f"""{LAB}, nr AS (SELECT *, row_number() OVER (ORDER BY ms, symbol) - 1 AS k, count(*) OVER () AS n FROM rows),
fo AS (SELECT nr.*, f AS fold, CASE WHEN k < 500 + f * ((n - 500) // 4) - 12 THEN 'train' WHEN k >= 500 + f * ((n - 500) // 4) AND (f = 3 OR k < 500 + (f + 1) * ((n - 500) // 4)) THEN 'test' END AS part FROM nr, range(0, 4) t(f))"""


def labelled(spark, sf):
    scored = shared((spark.sparkContext.applicationId, sf, "scored"), lambda: scored_bars(spark, sf))
    rows = L.triple_barrier_labels(scored, L.Geometry(1.5, 2.0, 12), "long")
    return rows.filter(F.col("label").isNotNull()).select("symbol", "ms", "label", F.col("p_long").alias("p"))


@query("walk_forward_folds", f"{FOLDS} SELECT fold::int AS fold, part, count(*) AS n, {to_ts_sql('min(ms)')} AS first_ts, {to_ts_sql('max(ms)')} AS last_ts FROM fo WHERE part IS NOT NULL GROUP BY fold, part")
def walk_forward_folds(spark, sf):
    f = ml.walk_forward_folds(labelled(spark, sf), 4, 12, 500)
    return f.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), to_ts(F.min("ms")).alias("first_ts"), to_ts(F.max("ms")).alias("last_ts"))


@query("fold_auc", f"""{FOLDS}, te AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0::double AS rk FROM fo WHERE part = 'test')
SELECT fold::int AS fold, count(*) AS test_size, round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label) * sum(1 - label)), 6) AS auc, round(avg(label), 6) AS base_rate, round(avg((p >= 0.55)::int), 6) AS signal_rate,
 round(avg(label) FILTER (p >= 0.55), 6) AS precision_at_thr FROM te GROUP BY fold""")
def fold_auc(spark, sf):
    f = ml.walk_forward_folds(labelled(spark, sf), 4, 12, 500).filter("part = 'test'")
    return rounded(ml.fold_metrics(f, 0.55))


WINDOWS = [(0, 0, 5), (1, 5, 5), (2, 10, 5), (3, 24, 5)]
WSQL = f"""WITH {TICKS}, {bars_cte('1h')}, {NUMBERED}, wn(window_id, days_back, window_days) AS (VALUES {', '.join(str(w) for w in WINDOWS)}),
bo AS (SELECT symbol, window_id, mx - days_back::bigint * {DAY} AS hi, mx - (days_back + window_days)::bigint * {DAY} AS lo, '[-' || (days_back + window_days) || '..-' || days_back || ']' AS label FROM (SELECT symbol, max(ms) AS mx FROM bars GROUP BY 1), wn)"""


def windows(spark):
    return spark.createDataFrame(WINDOWS, "window_id int, days_back int, window_days int")


@query("oos_bounds", f"{WSQL} SELECT symbol, window_id, label, {to_ts_sql('lo')} AS lo, {to_ts_sql('hi')} AS hi FROM bo")
def oos_bounds(spark, sf):
    b = ml.window_bounds(inputs.bars(spark, sf), windows(spark))
    return b.select("symbol", "window_id", "label", to_ts("lo").alias("lo"), to_ts("hi").alias("hi"))


@query("oos_slices", f"""{WSQL}, r AS (SELECT n.*, window_id, lo FROM n JOIN bo USING (symbol) WHERE ms <= hi), f AS (SELECT window_id, symbol, min(i) AS fi FROM r WHERE ms >= lo GROUP BY 1, 2)
SELECT symbol, window_id, {to_ts_sql('ms')} AS ts, close, ms >= lo AS tradable FROM r JOIN f USING (window_id, symbol) WHERE i >= fi - 30""")
def oos_slices(spark, sf):
    b = number_on_grid(inputs.bars(spark, sf), ["symbol"], 3_600_000)
    out = ml.test_slice(b, ml.window_bounds(b, windows(spark)), 30)
    return out.select("symbol", "window_id", to_ts("ms").alias("ts"), "close", "tradable")


@query("oos_common_slices", f"""{WSQL}, cb AS (SELECT window_id, min(lo) AS lo, max(hi) AS hi FROM bo GROUP BY 1), r AS (SELECT n.*, window_id, lo FROM n, cb WHERE ms <= hi), f AS (SELECT window_id, symbol, min(i) AS fi FROM r WHERE ms >= lo GROUP BY 1, 2)
SELECT symbol, window_id, count(*) AS bars, count(*) FILTER (ms >= lo) AS tradable FROM r JOIN f USING (window_id, symbol) WHERE i >= fi - 30 GROUP BY symbol, window_id HAVING count(*) > 30""")
def oos_common_slices(spark, sf):
    b = number_on_grid(inputs.bars(spark, sf), ["symbol"], 3_600_000)
    out = ml.common_slices(b, ml.window_bounds(b, windows(spark)), 30)
    return out.groupBy("symbol", "window_id").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("tradable")).alias("tradable"))


@query("enough_history", f"{WSQL}, c AS (SELECT window_id, symbol, count(n.ms) AS k FROM bo LEFT JOIN n ON n.symbol = bo.symbol AND n.ms < lo GROUP BY 1, bo.symbol, symbol) SELECT window_id, min(k) AS least FROM c GROUP BY window_id HAVING min(k) >= 200".replace("SELECT window_id, symbol, count(n.ms) AS k", "SELECT window_id, bo.symbol, count(n.ms) AS k").replace("GROUP BY 1, bo.symbol, symbol", "GROUP BY 1, 2"))
def enough_history(spark, sf):
    b = inputs.bars(spark, sf)
    return ml.enough_history(b, ml.window_bounds(b, windows(spark)), 200)


@query("control_scorers", f"""WITH {TICKS}, {bars_cte('1h')}, c AS (SELECT symbol, 'always_long' AS control, 1.0::double AS l, 0.0::double AS s FROM bars UNION ALL SELECT symbol, 'always_short', 0.0, 1.0 FROM bars
 UNION ALL SELECT symbol, 'random', {hashed_sql("'long'", "'1'", 'symbol', 'ms')}, {hashed_sql("'short'", "'1'", 'symbol', 'ms')} FROM bars)
SELECT symbol, control, round(avg(l), 6) AS mean_long, round(avg(s), 6) AS mean_short FROM c GROUP BY ALL""")
def control_scorers(spark, sf):
    b = inputs.bars(spark, sf)
    out = None
    for kind in ("always_long", "always_short", "random"):
        p_long, p_short = ml.control_scores(kind, 1)
        part = b.groupBy("symbol").agg(F.avg(p_long).alias("mean_long"), F.avg(p_short).alias("mean_short")).withColumn("control", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


GEOMETRIES = {"base": L.Geometry(1.5, 2.0, 12), "tight": L.Geometry(1.0, 1.0, 12)}
BEFORE = [(0, 0, 6), (1, 8, 6)]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS)
_BUNDLES = " UNION ALL ".join(f"""SELECT window_id, '{name}' AS geometry, '{d}' AS direction, {g.tp_mult}::double AS tp_atr_mult, {g.sl_mult}::double AS sl_atr_mult, count(*) AS n_samples, round(avg(label), 6) AS base_rate
  FROM (SELECT symbol, ts, label, lead(epoch_us(ts) // 1000, {g.horizon + 1}) OVER (PARTITION BY symbol ORDER BY ts) AS seen FROM ({_label_sql(d, g.horizon, g.tp_mult, g.sl_mult)})) JOIN fe USING (symbol, ts) JOIN bo USING (symbol)
  WHERE label IS NOT NULL AND seen < lo GROUP BY window_id""" for name, g in GEOMETRIES.items() for d in ("long", "short"))


@query("ml_bundle_round_trip", f"""WITH {TICKS}, {bars_cte('1h')}, wn(window_id, days_back, window_days) AS (VALUES {', '.join(str(w) for w in BEFORE)}),
bo AS (SELECT symbol, window_id, mx - days_back::bigint * {DAY} AS hi, mx - (days_back + window_days)::bigint * {DAY} AS lo FROM (SELECT symbol, max(ms) AS mx FROM bars GROUP BY 1), wn),
fe AS MATERIALIZED (SELECT symbol, ts FROM ({_feature_sql()}) WHERE {_COMPLETE}), bu AS ({_BUNDLES}),
sc AS (SELECT window_id, count(*) AS scored FROM fe JOIN bo USING (symbol) WHERE epoch_us(ts) // 1000 BETWEEN lo AND hi GROUP BY 1)
SELECT window_id, geometry, direction, tp_atr_mult, sl_atr_mult, n_samples, base_rate, {len(FEATURE_COLUMNS)} AS n_features, '{','.join(FEATURE_COLUMNS)}' AS features, coalesce(scored, 0) AS scored FROM bu LEFT JOIN sc USING (window_id)""")
def ml_bundle_round_trip(spark, sf):
    """Both sides and every geometry fitted before each window, saved, loaded and applied to the window's bars."""
    path = scratch(spark, "bundles")
    # the features of all bars are made once; the windows' bounds, the fits and the scored bars come from them
    rows = durable(FE.compute_features(inputs.bars(spark, sf), "1h"))
    bounds = durable(ml.window_bounds(rows, spark.createDataFrame(BEFORE, "window_id int, days_back int, window_days int")))
    bundles = ml.load_bundles(ml.fit_bundles(rows, bounds, GEOMETRIES, path))
    inside = durable(rows.join(bounds.select("window_id", "symbol", "lo", "hi"), "symbol").filter(F.col("ms").between(F.col("lo"), F.col("hi"))))
    loaded = [(m["window_id"], m["geometry"], m["direction"], m["tp_atr_mult"], m["sl_atr_mult"], m["n_samples"], m["base_rate"], len(names), ",".join(names))
              for _, names, m in bundles]
    table = spark.createDataFrame(loaded, "window_id int, geometry string, direction string, tp_atr_mult double, sl_atr_mult double, n_samples long, base_rate double, n_features int, features string")
    if not loaded:
        return table.withColumn("scored", F.lit(0).cast("long"))
    scored = ml.score_bundles(inside, bundles).groupBy("window_id", "geometry", "direction").agg(F.count("p").alias("scored"))
    return rounded(table.join(scored, ["window_id", "geometry", "direction"], "left").withColumn("scored", F.coalesce("scored", F.lit(0))))


TREES = 12


@query("train_gbt")
def train_gbt(spark, sf):
    """Walk-forward fit on all 26 features in five folds; fewer trees than the default's 400 (README has the figures).

    A table with too few complete rows for the folds has no metrics."""
    rows = ml.training_set(inputs.bars(spark, sf), "1h", L.Geometry(1.5, 2.0, 12), "long", holdout_days=2)
    try:
        _, metrics = ml.train_walk_forward(rows.select("symbol", "ms", "label", *FEATURE_COLUMNS), FEATURE_COLUMNS, 5, 12, 500, 0.55, trees=TREES)
    except ml.TooFewRows:
        return spark.createDataFrame([], "fold int, test_size long, auc double, base_rate double, signal_rate double, precision_at_thr double, train_size long")
    return rounded(metrics)
