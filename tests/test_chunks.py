"""Ordered operators give the same answer however a key is cut into chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from walks import HOUR, atr, fold, walk_bars

from tickloom.functions.scalars import Costs
from tickloom.operators import asof, chunking, features, labels, outcomes
from tickloom.session import CHUNK_ROWS_CONF


def frame(spark, *parts):
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def test_ordinals_and_running(tiny_chunks):
    pdf = pd.concat([walk_bars(500, 1, "HOT"), walk_bars(20, 2, "COLD")])
    df = chunking.number_on_grid(frame(tiny_chunks, pdf), ["symbol"], HOUR)
    out = chunking.running(df, ["symbol"], {
        "total": ("sum", F.col("volume")), "peak": ("max", F.col("close")), "grown": ("prod", F.col("close") / 100),
        "seen": ("last", F.when(F.col("volume") > 80, F.col("i")))}).toPandas().sort_values(["symbol", "i"])
    for name, g in out.groupby("symbol"):
        want = pdf[pdf.symbol == name].reset_index(drop=True)
        assert g.i.tolist() == list(range(len(want)))
        assert g.total.tolist() == want.volume.cumsum().tolist()
        np.testing.assert_allclose(g.peak, want.close.cummax())
        np.testing.assert_allclose(g.grown, (want.close / 100).cumprod(), rtol=1e-9)
        np.testing.assert_array_equal(g.seen.astype(float), pd.Series(want.index, dtype=float).where(want.volume > 80).ffill())


def test_number_by_range_survives_one_hot_value(tiny_chunks):
    df = tiny_chunks.range(3000).select(F.lit("k").alias("key"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("v"), "id")
    got = chunking.number_by_range(df, ["key"], ["v", "id"]).toPandas().sort_values(["v", "id"])
    assert got.i.tolist() == list(range(3000))
    ranks = chunking.distinct_ranks(df, ["key"], "v").toPandas().sort_values("v")
    counts = got.groupby("v").size()
    assert ranks._peers.tolist() == counts.tolist()
    assert ranks._below.tolist() == (counts.cumsum() - counts).tolist()
    q = chunking.exact_quantile(df.withColumn("v", F.col("v").cast("double")), ["key"], "v", {"a": 0.31, "m": 0.5}, "id").first()
    assert (q.a, q.m) == (got.v.quantile(0.31), got.v.median())


def test_exponential_means_match_the_recurrence(tiny_chunks):
    pdf = walk_bars(600, 5)
    out = features.with_indicators(frame(tiny_chunks, pdf), "1h", ema=True, rsi_period=14).toPandas().sort_values("i")
    for span in (9, 21, 50):
        np.testing.assert_allclose(out[f"ema{span}"], pdf.close.ewm(span=span, adjust=False).mean(), rtol=1e-12)
    np.testing.assert_allclose(out.atr, atr(pdf), rtol=1e-12)


def test_features_do_not_depend_on_chunk_size_or_the_future(spark):
    pdf = walk_bars(420, 8)
    rates = spark.createDataFrame([("A", int(pdf.ms[k]) + 5, k / 1e4) for k in range(0, 420, 7)], "symbol string, ms long, rate double")
    names = features.active_features(True)

    def run(rows, n):
        spark.conf.set(CHUNK_ROWS_CONF, str(rows))
        try:
            return features.compute_features(frame(spark, pdf.head(n)), "1h", rates=rates).toPandas().sort_values("i")[names].astype(float)
        finally:
            spark.conf.unset(CHUNK_ROWS_CONF)

    whole = run(1 << 16, 420)
    np.testing.assert_allclose(run(48, 420), whole, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(run(48, 300), whole.head(300), rtol=1e-9, atol=1e-12)
    assert whole.iloc[-1].notna().all()


@pytest.mark.parametrize("grid", [None, HOUR])
def test_asof_matches_pandas(tiny_chunks, grid):
    left, rng = walk_bars(300, 4), np.random.default_rng(0)
    right = pd.DataFrame({"symbol": "A", "ms": np.sort(rng.choice(np.arange(left.ms[20], left.ms[299]), 80, replace=False)), "x": rng.uniform(size=80)})
    right.loc[3, "ms"] = left.ms[40]
    right = right.sort_values("ms").drop_duplicates("ms")
    got = asof.asof_backward(frame(tiny_chunks, left).select("symbol", "ms"), tiny_chunks.createDataFrame(right), ["symbol"], ["x"], grid_ms=grid)
    want = pd.merge_asof(left[["symbol", "ms"]], right[["ms", "x"]], on="ms")
    np.testing.assert_array_equal(got.toPandas().sort_values("ms").x.astype(float), want.x)


def test_interpolation_matches_numpy(tiny_chunks):
    rng = np.random.default_rng(2)
    ref = pd.DataFrame({"a": np.sort(rng.uniform(0.1, 0.9, 60)), "b": rng.uniform(size=60)})
    pts = pd.DataFrame({"id": range(200), "x": rng.uniform(size=200)})
    out = asof.interpolate(tiny_chunks.createDataFrame(pts), tiny_chunks.createDataFrame(ref), "x", "a", "b", "y").toPandas().sort_values("id")
    np.testing.assert_allclose(out.y, np.interp(pts.x, ref.a, ref.b), rtol=1e-12)


@pytest.mark.parametrize("timeout,rollover", [(None, True), (None, False), (3, True)])
def test_trades_equal_a_sequential_evaluation(tiny_chunks, timeout, rollover):
    costs = Costs(0.001, 0.0004, 0.0002)
    rules = outcomes.Rules(labels.Geometry(1.5, 2.0, 9), costs, 0.7, rollover, timeout)
    parts = [walk_bars(700, 21, "HOT"), walk_bars(90, 22, "COLD")]
    df = features.with_indicators(frame(tiny_chunks, *parts), "1h")
    side = labels.stronger_side("p_long", "p_short", 0.7)
    scored = df.withColumn("_s", side).select("*", F.col("_s.side").alias("side"), F.col("_s.p").alias("p_side"))
    booked = outcomes.evaluate(scored, rules).persist()
    got = booked.filter("exit_reason is not null").toPandas()
    curve = outcomes.equity_curve(scored.select("symbol", "i", "ms", "close"), booked, rules).toPandas()
    assert got.rollovers.sum() > 0 or not rollover
    for part in parts:
        name = part.symbol[0]
        want, equity = fold(part, 9, 1.5, 2.0, 0.7, 0.0002, 0.001, 0.0004, timeout, rollover)
        g = got[got.symbol == name].sort_values("entry_i")
        assert list(zip(g.entry_i, g.exit_i, g.side, g.exit_reason)) == [w[:4] for w in want]
        np.testing.assert_allclose(g[["qty", "entry_price", "exit_price", "pnl"]], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(curve[curve.symbol == name].sort_values("i").equity, equity, rtol=1e-9)


def test_exponential_means_keep_every_term(tiny_chunks):
    """A series that falls by 250 orders of magnitude still remembers where it came from."""
    from tickloom.operators.chunking import with_halo
    from tickloom.operators.rolling import Ewm, add_ewm
    values = [1e200] * 5 + [1e-50] * 400
    frame = tiny_chunks.createDataFrame([("a", i, v) for i, v in enumerate(values)], "symbol string, i long, close double")
    specs = {"slow": Ewm("close", 0.5), "fast": Ewm("close", 0.9)}
    rows, _ = with_halo(frame, ["symbol"], back=3)
    got = {r.i: r for r in add_ewm(rows, ["symbol"], specs, ["close"]).collect()}
    for name, spec in specs.items():
        y = values[0]
        for i, v in enumerate(values):
            y = v if i == 0 else (1 - spec.alpha) * y + spec.alpha * v
            assert abs(got[i][name] - y) <= 1e-9 * y


def test_exponential_means_equal_a_sequential_fold(tiny_chunks):
    """Reaches of a few rows to many chunks, keys of one row to many chunks, late seeds, over chunks and blocks."""
    from tickloom.operators.chunking import with_halo
    from tickloom.operators.rolling import Ewm, add_ewm, block_rows
    rng = np.random.default_rng(9)
    values = {"a": rng.uniform(1, 2, 1000).tolist(), "b": rng.normal(size=49).tolist(), "c": [3.0], "d": (rng.uniform(1, 2, 300) * 1e12).tolist()}
    frame = tiny_chunks.createDataFrame([(k, i, v) for k, own in values.items() for i, v in enumerate(own)], "symbol string, i long, x double")
    specs = {"e9": Ewm("x", 0.2), "e50": Ewm("x", 2 / 51, min_periods=14), "slow": Ewm("x", 0.002, first=1), "last": Ewm("x", 1.0), "quick": Ewm("x", 0.99, first=5, min_periods=3)}
    assert block_rows(specs, 48) == 48 and block_rows({"e": Ewm("x", 0.9999)}, 65536) == 16 and block_rows({"e": Ewm("x", 1 / 14)}, 65536) == 2048
    rows, _ = with_halo(frame, ["symbol"], back=2)
    got = {(r.symbol, r.i): r for r in add_ewm(rows, ["symbol"], specs, ["x"]).collect()}
    assert len(got) == sum(map(len, values.values()))
    for key, own in values.items():
        for name, spec in specs.items():
            y = size = None
            for i, v in enumerate(own):
                if i >= spec.first:
                    y = v if i == spec.first else (1 - spec.alpha) * y + spec.alpha * v
                    size = abs(v) if i == spec.first else (1 - spec.alpha) * size + spec.alpha * abs(v)
                want = None if y is None or i < spec.first + spec.min_periods - 1 else y
                mine = got[key, i][name]
                assert (mine is None) == (want is None) and (want is None or abs(mine - want) <= 1e-12 * size), (key, name, i, mine, want)
