"""Walk-forward training, scoring and control scorers on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import chain
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.chunking import distinct_ranks, number_by_range, number_by_slot
from tickloom.operators.features import FEATURE_COLUMNS, complete_rows, compute_features
from tickloom.operators.labels import Geometry, barrier_labels, structure_barriers, triple_barrier_labels
from tickloom.session import durable


def training_set(bars: DataFrame, timeframe: str, geometry: Geometry, direction: str, holdout_days: int = 0,
                 train_days: int | None = None, rates: DataFrame | None = None, structure: bool = False) -> DataFrame:
    """Features and labels of all symbols in one job, without the newest ``holdout_days`` (strictly)
    and limited to the ``train_days`` before them."""
    newest = bars.groupBy("symbol").agg(F.max("ms").alias("_newest"))
    cut = bars.join(newest, "symbol")
    if holdout_days:
        cut = cut.filter(F.col("ms") < F.col("_newest") - holdout_days * 86_400_000)
    if train_days:
        cut = cut.filter(F.col("ms") >= F.col("_newest") - (holdout_days + train_days) * 86_400_000)
    rows = compute_features(cut.drop("_newest"), timeframe, rates=rates)
    if structure:
        side = "long" if direction == "long" else "short"
        return barrier_labels(structure_barriers(rows), geometry.horizon, direction, f"{side}_tp", f"{side}_sl")
    return triple_barrier_labels(rows, geometry, direction)


def in_time(rows: DataFrame, slot_ms: int = 86_400_000) -> DataFrame:
    """Rows with the ordinal ``i`` of (ms, symbol): counted per time slot, numbered inside it. Nothing is range-sorted."""
    return number_by_slot(rows, [], F.floor(F.col("ms") / slot_ms).cast("long"), ["ms", "symbol"])


def walk_forward_folds(rows: DataFrame, n_folds: int, purge: int, min_train: int, order: Sequence[str] = ("ms", "symbol")) -> DataFrame:
    """Rows tagged (fold, part): expanding train part, purge gap, test part; the last fold takes the rest.

    ``order`` by time gives true walk-forward folds; order by (symbol, ms) reproduces positional ones. Which folds a row
    belongs to follows from its ordinal, so a row is repeated only for these.
    """
    numbered = in_time(rows) if tuple(order) == ("ms", "symbol") else number_by_range(rows, [], list(order))
    size = fold_size(rows.count(), n_folds, min_train)
    i = F.col("i")
    test = F.when(i >= min_train, F.least(F.floor((i - min_train) / size), F.lit(n_folds - 1))).cast("int")
    trains = F.greatest(F.lit(0), F.floor((i + purge - min_train) / size) + 1).cast("int")
    every = F.array_append(
        F.when(trains < n_folds, F.transform(F.sequence(trains, F.greatest(trains, F.lit(n_folds - 1))), lambda f: F.struct(f.alias("fold"), F.lit("train").alias("part"))))
        .otherwise(F.array().cast("array<struct<fold:int,part:string>>")), F.struct(test.alias("fold"), F.lit("test").alias("part")))
    tagged = numbered.withColumn("_f", F.explode(every)).filter(F.col("_f.fold").isNotNull())
    return tagged.select("*", "_f.*").drop("_f")


class TooFewRows(ValueError):
    """A table is too short for the folds asked for."""


def fold_size(count: int, n_folds: int, min_train: int) -> int:
    size = (count - min_train) // n_folds
    if size <= 0:
        raise TooFewRows("not enough rows for the folds")
    return size


def classifier(features: Sequence[str] = tuple(FEATURE_COLUMNS), trees: int = 400, seed: int = 7, **overrides) -> Pipeline:
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, stepSize=0.03, maxDepth=5,
                        minInstancesPerNode=200, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    gbt.setParams(**overrides) if overrides else None
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), gbt])


def score(model: PipelineModel, rows: DataFrame, features: Sequence[str], out: str = "p") -> DataFrame:
    """Probability where every feature is present, NULL elsewhere."""
    valid = complete_rows(rows, features)
    scored = model.transform(valid).withColumn(out, vector_to_array("probability")[1])
    scored = scored.drop("_features", "rawPrediction", "probability", "prediction")
    gaps = rows.filter(" OR ".join(f"`{f}` IS NULL" for f in features))
    return scored.unionByName(gaps, allowMissingColumns=True)


def fold_metrics(scored: DataFrame, threshold: float, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """AUC (rank sums; NULL with one class), base rate, signal rate and precision at the threshold."""
    keys = list(keys)
    ranks = distinct_ranks(scored, keys, "p")
    rows = scored.join(ranks, [*keys, "p"])
    pos = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    neg = F.sum(F.when(F.col("label") == 0, 1).otherwise(0))
    rank_sum = F.sum(F.when(F.col("label") == 1, F.col("_below") + (F.col("_peers") + 1) / 2.0))
    auc = (rank_sum - pos * (pos + 1) / 2.0) / F.nullif(pos * neg, F.lit(0))
    hit = F.col("p") >= threshold
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_size"), auc.alias("auc"), F.avg("label").alias("base_rate"),
        F.avg(hit.cast("int")).alias("signal_rate"), F.avg(F.when(hit, F.col("label"))).alias("precision_at_thr"))


def train_walk_forward(rows: DataFrame, features: Sequence[str], n_folds: int, purge: int, min_train: int, threshold: float,
                       **params) -> tuple[PipelineModel, DataFrame]:
    """Fit and score every fold, then fit on everything; (model, metrics per fold).

    Rows are stored once with their ordinal; a fold's parts are ranges of it. The loop runs over folds; each fit and score
    is a distributed job.
    """
    data = durable(in_time(complete_rows(rows, features, "label")))
    count = data.count()
    size = fold_size(count, n_folds, min_train)
    scored = None
    for fold in range(n_folds):
        start = min_train + fold * size
        stop = count if fold == n_folds - 1 else start + size
        model = classifier(features, **params).fit(data.filter(F.col("i") < start - purge))
        part = score(model, data.filter(F.col("i").between(start, stop - 1)), features)
        part = part.select(F.lit(fold).alias("fold"), F.lit(start - purge).cast("long").alias("train_size"), "symbol", "ms", "label", "p")
        scored = part if scored is None else scored.unionByName(part)
    held = durable(scored)
    metrics = fold_metrics(held, threshold).join(held.groupBy("fold").agg(F.first("train_size").alias("train_size")), "fold")
    return classifier(features, **params).fit(data), metrics


def save_bundle(model: PipelineModel, path: str, features: Sequence[str], meta: dict) -> None:
    """Model plus its own feature list and metadata, all through Spark's file system layer."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    body = json.dumps({"features": list(features), **meta})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_bundle(path: str) -> tuple[PipelineModel, list[str], dict]:
    meta = json.loads(SparkSession.active().read.text(f"{path}/meta").first()[0])
    return PipelineModel.load(f"{path}/model"), meta.pop("features"), meta


def _side_by_side(spark: SparkSession, work: Callable, items: Iterable, threads: int) -> list:
    """``work`` of every item in order, a few at a time: a fit is many short jobs, which leave a cluster waiting one by one."""
    pool = ThreadPool(threads)
    try:
        return pool.map(inheritable_thread_target(spark)(work), list(items), chunksize=1)
    finally:
        pool.terminate()


def fit_bundles(rows: DataFrame, bounds: DataFrame, geometries: Mapping[str, Geometry], path: str,
                features: Sequence[str] = tuple(FEATURE_COLUMNS), threads: int = 8, **params) -> DataFrame:
    """One model per window, geometry and direction, fitted on bars strictly before the window and saved below ``path``.

    ``rows`` is the feature table of all bars; it and ``bounds`` are read once per geometry and direction, so give tables
    that are kept. Features look back only, so all windows share them; labels are made on the bars before each window, so
    none looks into it. Returns the index of the bundles (window_id, geometry, direction, barriers, n_samples, base_rate,
    path), which is also saved. Every fit is a distributed job, ``threads`` of the grid's run side by side, those of one
    geometry's windows too.
    """
    spark = rows.sparkSession
    known = bounds.select("window_id", "symbol", "lo")

    def label(at: tuple[str, str]) -> list[tuple]:
        name, direction = at
        before = rows.join(known, "symbol").filter(F.col("ms") < F.col("lo"))
        labelled = triple_barrier_labels(before, geometries[name], direction, ["window_id", "symbol"])
        data = durable(complete_rows(labelled, features, "label").select("window_id", "label", *features))
        counts = data.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).orderBy("window_id")
        return [(name, direction, data, r) for r in counts.collect()]  # the grid's entries

    def fit(at: tuple) -> tuple:
        name, direction, data, r = at
        geometry = geometries[name]
        model = classifier(features, **params).fit(data.filter(F.col("window_id") == r.window_id))
        meta = {"window_id": r.window_id, "geometry": name, "direction": direction, "tp_atr_mult": geometry.tp_mult,
                "sl_atr_mult": geometry.sl_mult, "horizon": geometry.horizon, "n_samples": r.n, "base_rate": r.rate}
        place = f"{path}/window={r.window_id}/geometry={name}/direction={direction}"
        save_bundle(model, place, features, meta)
        return (*meta.values(), place)

    grid = [(name, direction) for name in geometries for direction in ("long", "short")]
    made = _side_by_side(spark, fit, chain.from_iterable(_side_by_side(spark, label, grid, threads)), threads)
    schema = "window_id int, geometry string, direction string, tp_atr_mult double, sl_atr_mult double, horizon int, n_samples long, base_rate double, path string"
    index = spark.createDataFrame(made, schema)
    index.write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def load_bundles(index: DataFrame, threads: int = 4) -> list[tuple[PipelineModel, list[str], dict]]:
    """Every bundle of an index, each loaded once."""
    return _side_by_side(index.sparkSession, load_bundle, [r.path for r in index.select("path").collect()], threads)  # the grid's entries


def score_bundles(rows: DataFrame, bundles: Sequence[tuple[PipelineModel, list[str], dict]]) -> DataFrame:
    """Rows of each window (column ``window_id``) with the probability ``p`` of every bundle loaded for it, by geometry and
    direction; NULL where a feature is missing. Each bundle applies the feature list it was saved with.

    ``rows`` is read twice per bundle, so give a table that is kept."""
    out = None
    for model, features, meta in bundles:
        part = score(model, rows.filter(F.col("window_id") == meta["window_id"]), features)
        part = part.select("window_id", F.lit(meta["geometry"]).alias("geometry"), F.lit(meta["direction"]).alias("direction"), "symbol", "ms", "p")
        out = part if out is None else out.unionByName(part)
    return out


def control_scores(kind: str, seed: int = 0) -> tuple[Column, Column]:
    """(p_long, p_short) of a scorer that knows nothing.

    'random' hashes (symbol, ms, seed): independent per pair, the same on any partitioning and in any engine with md5.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    if kind == "always_long":
        return one, zero
    if kind == "always_short":
        return zero, one
    if kind != "random":
        raise ValueError(f"unknown control {kind!r}")
    def draw(salt: str) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(salt), F.lit(str(seed)), "symbol", F.col("ms").cast("string")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    return draw("long"), draw("short")


def with_scorers(rows: DataFrame, scores: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Every row once per scorer, with that scorer's ``p_long`` and ``p_short``: all scorers are judged on the same bars in
    one job, the scorer being one more key."""
    made = F.explode(F.array(*[F.struct(F.lit(name).alias("scorer"), p_long.alias("p_long"), p_short.alias("p_short")) for name, (p_long, p_short) in scores.items()]))
    return rows.withColumn("_scored", made).drop("p_long", "p_short").select("*", "_scored.*").drop("_scored")


# --- out-of-sample windows ---------------------------------------------------------------------

def window_bounds(bars: DataFrame, windows: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """lo/hi per (window, key) from (window_id, days_back, window_days), relative to each key's newest bar."""
    newest = bars.groupBy(*keys).agg(F.max("ms").alias("_newest"))
    both = newest.crossJoin(F.broadcast(windows))
    hi = F.col("_newest") - F.col("days_back") * 86_400_000
    label = F.format_string("[-%d..-%d]", F.col("days_back") + F.col("window_days"), F.col("days_back"))
    return both.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("window_days") * 86_400_000).withColumn("label", label).drop("_newest")


def train_slice(bars: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.join(bounds.select("window_id", *keys, "lo"), list(keys)).filter(F.col("ms") < F.col("lo"))


def test_slice(numbered: DataFrame, bounds: DataFrame, warmup: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars of the window preceded by up to ``warmup`` earlier bars; ``tradable`` marks the window itself."""
    rows = numbered.join(bounds.select("window_id", *keys, "lo", "hi"), list(keys)).filter(F.col("ms") <= F.col("hi"))
    first = rows.filter(F.col("ms") >= F.col("lo")).groupBy("window_id", *keys).agg(F.min("i").alias("_first"))
    kept = rows.join(first, ["window_id", *keys]).filter(F.col("i") >= F.col("_first") - warmup)
    return kept.withColumn("tradable", F.col("ms") >= F.col("lo")).drop("_first")


def common_slices(numbered: DataFrame, bounds: DataFrame, warmup: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """As ``test_slice`` with one lo/hi per window for all keys (earliest lo, latest hi); keys left
    with no more than ``warmup`` rows are dropped."""
    shared = bounds.groupBy("window_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    wide = bounds.select("window_id", *keys).join(shared, "window_id")
    rows = test_slice(numbered, wide, warmup, keys)
    enough = rows.groupBy("window_id", *keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > warmup)
    return rows.join(enough.drop("_n"), ["window_id", *keys], "left_semi")


def enough_history(bars: DataFrame, bounds: DataFrame, min_bars: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Windows for which every key has at least ``min_bars`` bars before the window."""
    counts = train_slice(bars, bounds, keys).groupBy("window_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    full = bounds.select("window_id", *keys).join(counts, ["window_id", *keys], "left")
    return full.groupBy("window_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("least")).filter(F.col("least") >= min_bars)
