"""Out-of-sample windows against a bar-by-bar fold that may only trade inside the window."""

import numpy as np
import pandas as pd
import pytest
from oracle_check import compare, connect
from walks import fold, walk_bars

from tickloom.functions.scalars import Costs
from tickloom.operators import features, ml, outcomes, windows
from tickloom.operators.chunking import number_on_grid
from tickloom.operators.features import with_indicators
from tickloom.operators.labels import Geometry, stronger_side
from tickloom.plans import inputs, learning
from tickloom.plans import windows as plans
from tickloom.plans.common import forget_shared
from pyspark.sql import functions as F

SPANS = [(0, "A", 0, 399), (1, "A", 120, 330), (2, "A", 130, 131), (3, "A", 200, 200), (4, "A", 20, 90), (0, "B", 5, 399), (1, "B", 47, 97), (2, "B", 390, 399)]


def scored(spark, parts):
    frame = spark.createDataFrame(pd.concat(parts))
    rows = with_indicators(frame, "1h")
    return rows.withColumn("_s", stronger_side("p_long", "p_short", 0.7)).select("*", F.col("_s.side").alias("side"), F.col("_s.p").alias("p_side")).drop("_s")


def inside(part, first, last):
    """The bars up to ``last``, with no signal before ``first``."""
    cut = part.iloc[:last + 1].copy()
    cut.loc[cut.index[:first], ["p_long", "p_short"]] = 0.0
    return cut


@pytest.mark.parametrize("rollover,timeout", [(True, None), (False, None), (True, 3)])
def test_window_trades(tiny_chunks, rollover, timeout):
    parts = [walk_bars(400, 3, "A"), walk_bars(400, 8, "B")]
    rules = outcomes.Rules(Geometry(1.5, 2.0, 9), Costs(slippage=0.0002, taker_fee=0.001, maker_fee=0.0004), threshold=0.7, rollover=rollover, maker_timeout=timeout)
    rows = scored(tiny_chunks, parts)
    spans = tiny_chunks.createDataFrame(SPANS, "window_id int, symbol string, first long, last long")
    booked = windows.window_trades(rows, spans, rules)
    got = booked.toPandas()
    curve = windows.window_curves(rows.select("symbol", "i", "ms", "close"), spans, booked, rules).toPandas()
    by_name = {p.symbol[0]: p.reset_index(drop=True) for p in parts}
    taken = 0
    for window, name, first, last in SPANS:
        want, equity = fold(inside(by_name[name], first, last), 9, 1.5, 2.0, 0.7, 0.0002, 0.001, 0.0004, timeout, rollover)
        own = got[(got.window_id == window) & (got.symbol == name) & got.exit_reason.notna()].sort_values("entry_i")
        assert list(zip(own.entry_i, own.exit_i, own.side, own.exit_reason)) == [w[:4] for w in want]
        if want:
            np.testing.assert_allclose(own[["qty", "entry_price", "exit_price", "pnl"]], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
        line = curve[(curve.window_id == window) & (curve.symbol == name)].sort_values("i")
        assert line.i.tolist() == list(range(first, last + 1))
        np.testing.assert_allclose(line.equity, equity[first:], rtol=1e-9)
        taken += len(want)
    assert taken > 20


@pytest.mark.parametrize("start", [0, 47, 48, 100, 399])
def test_chain_from_a_start(tiny_chunks, start):
    part = walk_bars(400, 5, "A")
    rules = outcomes.Rules(Geometry(1.5, 2.0, 9), Costs(slippage=0.0002, taker_fee=0.001), threshold=0.7)
    nodes = outcomes.legs(scored(tiny_chunks, [part]), rules).withColumn("from", F.lit(start))
    taken = outcomes.chain(nodes, rules.reach, start="from")
    got = outcomes.trades(taken, rules).filter("exit_reason is not null").orderBy("entry_i").collect()
    want, _ = fold(inside(part, start, 399), 9, 1.5, 2.0, 0.7, 0.0002, 0.001)
    assert [(r.entry_i, r.exit_i, r.side, r.exit_reason) for r in got] == [w[:4] for w in want]


def test_no_window_and_no_bar(tiny_chunks):
    part = walk_bars(60, 5, "A")
    rules = outcomes.Rules(Geometry(1.5, 2.0, 9), threshold=0.7)
    rows = scored(tiny_chunks, [part])
    none = tiny_chunks.createDataFrame([], "window_id int, symbol string, first long, last long")
    assert windows.window_trades(rows, none, rules).count() == 0
    assert windows.window_trades(rows.limit(0), none, rules).count() == 0


def test_legs_only_where_a_window_reaches(tiny_chunks, monkeypatch):
    rows = scored(tiny_chunks, [walk_bars(400, 3, "A"), walk_bars(400, 8, "B")])
    rules = outcomes.Rules(Geometry(1.5, 2.0, 9), threshold=0.7)
    spans = tiny_chunks.createDataFrame([(0, "A", 100, 130), (1, "A", 120, 150)], "window_id int, symbol string, first long, last long")
    seen, whole = [], windows.legs

    def counted(df, *args):
        seen.append({(r.symbol, r.i) for r in df.select("symbol", "i").collect()})
        return whole(df, *args)

    monkeypatch.setattr(windows, "legs", counted)
    assert windows.window_trades(rows, spans, rules).count() > 0
    assert seen == [{("A", i) for i in range(100, 150 + rules.reach + 1)}]


def test_held_out_reads_ticks_once(spark, monkeypatch):
    calls, ticks = [], inputs.ticks
    monkeypatch.setattr(inputs, "ticks", lambda *args: calls.append(args) or ticks(*args))
    forget_shared()
    assert plans.held_out(spark, "/root/testdata/sf0.001").count() == len(plans.SCORERS)
    assert len(calls) == 1
    forget_shared()


def test_bundles_make_features_once(spark, monkeypatch):
    calls, whole = [], features.compute_features
    for module in (features, ml):
        monkeypatch.setattr(module, "compute_features", lambda *args, **kwargs: calls.append(args) or whole(*args, **kwargs))
    out = learning.ml_bundle_round_trip(spark, "/root/testdata/sf0.01")
    assert not [f for f in out.inputFiles() if "events.parquet" in f]  # scores do not come from the ticks anew
    assert len(calls) == 1
    rows = out.collect()
    assert len({(r.window_id, r.geometry, r.direction) for r in rows}) == len(rows) == 2 * len(learning.GEOMETRIES) * len(learning.BEFORE)
    assert all(r.scored > 0 for r in rows)


def test_bundles_are_fitted_whole(spark, monkeypatch):
    asked, whole = [], ml.classifier

    def short(features, **params):
        pipe = whole(features, **params)
        asked.append((pipe.getStages()[-1].getMaxIter(), pipe.getStages()[-1].getMaxDepth()))
        return whole(features, trees=1, maxDepth=1)  # what was asked for is what counts here

    monkeypatch.setattr(ml, "classifier", short)
    got = learning.ml_bundle_round_trip(spark, "/root/testdata/sf0.01").toPandas()
    assert asked == [(400, 5)] * 2 * len(learning.GEOMETRIES) * len(learning.BEFORE)
    assert compare(got, connect("/root/testdata/sf0.01").execute(learning.ORACLE["ml_bundle_round_trip"]).df()) == ""
