"""Small literal cases, mirror symmetry and accounting rules."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from walks import HOUR, walk_bars

from tickloom.functions.scalars import Costs, alert_category, path_safe, perpetual_symbol, round_trip_cost_pct
from tickloom.functions.timeframes import periods_per_year
from tickloom.operators import alerts, bars, curves, labels, metrics, portfolio, ranking, screen, studies


def flat(spark, pokes):
    rows = [{"symbol": "A", "i": k, "ms": k * HOUR, "open": 100.0, "high": 100.0, "low": 100.0, "close": 100.0, "atr": 1.0} for k in range(20)]
    for (k, column), value in pokes.items():
        rows[k][column] = value
    return spark.createDataFrame(pd.DataFrame(rows))


def labelled(spark, pokes, direction="long"):
    out = labels.triple_barrier_labels(flat(spark, pokes), labels.Geometry(2.0, 1.0, 5), direction).toPandas().sort_values("i")
    return out.label.tolist(), out.hit_step.tolist()


def test_barrier_order(spark):
    label, hit = labelled(spark, {(3, "high"): 102.5})
    assert label[:3] == [1, 1, 1] and hit[1] == 1
    assert all(math.isnan(x) for x in label[-6:]) and not math.isnan(label[-7])
    assert labelled(spark, {(3, "low"): 98.5, (5, "high"): 102.5})[0][1] == 0
    assert labelled(spark, {(3, "high"): 103.0, (3, "low"): 98.0})[0][2] == 0
    label, hit = labelled(spark, {})
    assert label[0] == 0 and math.isnan(hit[0])


def test_mirrored_prices_mirror_labels(spark):
    up = labelled(spark, {(3, "high"): 102.5, (9, "low"): 98.0})[0]
    down = labelled(spark, {(3, "low"): 97.5, (9, "high"): 102.0}, "short")[0]
    assert np.array_equal(up, down, equal_nan=True)


def test_periods_and_costs():
    assert (periods_per_year("4h"), periods_per_year("1h")) == (2190, 8760)
    assert math.isclose(round_trip_cost_pct(Costs(0.001, 0.0002, 0.0005)), 0.3)
    assert math.isclose(round_trip_cost_pct(Costs(0.001, 0.0002, 0.0005), maker=True), 0.04)


def test_matched_exposure(spark):
    market = spark.createDataFrame([("A", k, c) for k, c in enumerate((100.0, 110.0, 121.0, 133.1))], "symbol string, i long, close double")
    account = spark.createDataFrame([(k, 100.0, 100.0 * (1 - x)) for k, x in enumerate((0.0, 0.5, 1.0, 1.0))], "i long, equity double, cash double")
    out = curves.matched_exposure(market, account, 1000.0).toPandas().sort_values("i")
    np.testing.assert_allclose(out.equity, [1000, 1000, 1050, 1155])


def test_hysteresis(spark):
    dd = [-0.04, -0.11, -0.08, -0.12, -0.04, -0.10]
    curve = spark.createDataFrame([("b", k, d) for k, d in enumerate(dd)], "book string, i long, drawdown double")
    assert sorted(r.i for r in alerts.hysteresis_alerts(curve, ["book"], 0.10).collect()) == [1, 5]


def test_settlement_serves_buys_in_order(spark):
    holdings = spark.createDataFrame([("b", "Z", 0.0)], "book string, symbol string, qty double")
    rows = spark.createDataFrame([("b", "X", 0.0, 1.0, 100.0, "buy", 60.0), ("b", "Y", 0.0, 1.0, 100.0, "buy", 70.0)],
                                 "book string, symbol string, qty double, price double, cash double, side string, order_qty double")
    got = portfolio.settle(rows, Costs(0.0, 0.0, 0.0)).toPandas().sort_values("symbol")
    assert got.filled_qty.tolist() == [60.0, 40.0]
    assert holdings.count() == 1


def test_months_and_sharpe(spark):
    dates = pd.date_range("2016-01-01", periods=400)
    panel = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": dates.date, "close": np.linspace(1, 2, 400)}))
    assert screen.monthly_returns(panel).count() == 13
    flat_curve = spark.createDataFrame([(k, 5.0) for k in range(9)], "i long, equity double")
    assert metrics.with_returns(flat_curve, []).agg(metrics.sharpe("ret", 10).alias("s")).first().s == 0.0


def test_legs_never_overlap_and_direction_is_checked(spark):
    scores = spark.createDataFrame([(0, f"s{k}", float(k)) for k in range(8)], "i long, symbol string, score double")
    legs = ranking.select_legs(scores, 5, 5).toPandas()
    assert sorted(legs.leg.tolist()) == [-1] * 3 + [1] * 5 and legs.symbol.is_unique
    try:
        ranking.leg_weights(ranking.select_legs(scores, 2, 2), "sideways")
    except ValueError:
        return
    raise AssertionError("an unknown direction must fail")


def rank_fold(px, look, skip, every, nl, ns, rate, initial):
    """Sequential book over a wide price table, long-short."""
    warm, cash, qty, out = look + skip + 1, initial, {}, []
    for i in range(warm, len(px)):
        row = px.iloc[i]
        equity = cash + sum(q * row[s] for s, q in qty.items())
        if (i - warm) % every == 0:
            score = (px.iloc[i - 1 - skip] / px.iloc[i - 1 - skip - look] - 1).sort_values(ascending=False)
            w = {s: 0.5 / nl for s in score.index[:nl]} | {s: -0.5 / ns for s in score.index[-ns:]}
            cost = 0.0
            for s in set(w) | set(qty):
                delta = w.get(s, 0.0) * equity / row[s] - qty.get(s, 0.0)
                cash -= delta * row[s]
                cost += abs(delta) * row[s] * rate
                qty[s] = w.get(s, 0.0) * equity / row[s]
            cash -= cost
        out.append(cash + sum(q * row[s] for s, q in qty.items()))
    return out


def test_rank_curve_equals_a_daily_walk(spark):
    rng = np.random.default_rng(4)
    px = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.02, (160, 9)), axis=0)), columns=list("ABCDEFGHI"))
    long = px.reset_index(names="i").melt("i", var_name="symbol", value_name="close")
    panel = spark.createDataFrame(long)
    w = ranking.scheduled_weights(panel, 20, 3, 10, 2, 2, "long_short")
    got = ranking.rebalanced_curve(panel, w, 0.002, 1000.0, first_row=24).toPandas().sort_values("i")
    np.testing.assert_allclose(got.equity, rank_fold(px, 20, 3, 10, 2, 2, 0.002, 1000.0), rtol=1e-10)


def test_gaps_merge_and_names(spark):
    b = spark.createDataFrame(walk_bars(120, 2))
    want = (walk_bars(120, 2).ms.diff().dropna() // HOUR - 1).pipe(lambda s: s[s > 0]).astype(int).tolist()
    assert [r.missing for r in bars.gaps(b, "1h").orderBy("gap_start").collect()] == want
    two = b.select("symbol", "ms", "close")
    merged = bars.merge_keep_existing(two, two.withColumn("close", F.lit(0.0)))
    assert merged.filter("close = 0").count() == 0 and merged.count() == 120
    row = spark.range(1).select(perpetual_symbol(F.lit("BTC/USDT")).alias("p"), path_safe(F.lit("BTC/USDT:USDT")).alias("s"),
                                alert_category(F.lit("connection"), F.lit(None).cast("double"), F.lit(None).cast("boolean")).alias("a")).first()
    assert tuple(row) == ("BTC/USDT:USDT", "BTC-USDT_USDT", "outage")


def test_t_probability():
    assert abs(studies.t_two_sided_p(2.228, 10) - 0.05) < 1e-3
    assert abs(studies.t_two_sided_p(1.0, 5) - 0.3632) < 1e-3


def test_permutations_are_reproducible_and_keep_the_mean(spark):
    rng = np.random.default_rng(1)
    t = spark.createDataFrame(pd.DataFrame({"window": np.arange(200) % 4, "id": [f"t{k}" for k in range(200)], "prob": rng.uniform(0.5, 1, 200), "r": rng.normal(0, 0.01, 200),
                                            "signal_ms": rng.integers(0, 10 ** 9, 200)}))
    sized = studies.multipliers(t, 0.75, "p", 0.5)
    assert all(abs(r.m - 1) < 1e-12 for r in sized.groupBy("window").agg(F.avg("mult").alias("m")).collect())
    a = studies.permutation_gains(sized, 5, 0.1).toPandas().sort_values("draw")
    b = studies.permutation_gains(sized.repartition(7), 5, 0.1).toPandas().sort_values("draw")
    np.testing.assert_allclose(a.pp, b.pp)
    assert a.pp.nunique() == 5


def test_vendor_charts_invent_nothing(spark):
    from tickloom.schemas import VENDOR_CHART
    from tickloom.sources.vendor import parse_charts
    quote = {"open": [None, 2.0], "high": None, "low": [0.5, None], "close": [1.5, 2.5], "volume": None}
    first = {"meta": {"symbol": "A"}, "timestamp": [86400, 172800], "indicators": {"quote": [quote]}}
    second = {"meta": {"symbol": "B"}, "timestamp": [86400], "indicators": {"quote": [{**quote, "close": [9.0]}]}}
    raw = spark.createDataFrame([({"result": [first, second], "error": None},), ({"result": [], "error": None},), ({"result": None, "error": None},)], VENDOR_CHART)
    got = [tuple(r) for r in parse_charts(raw).orderBy("date").drop("date").collect()]
    assert got == [("A", None, None, 0.5, 1.5, 0.0), ("A", 2.0, None, None, 2.5, 0.0)]


def test_loss_switch_takes_a_books_exits_in_time_order(spark):
    from tickloom.operators.outcomes import daily_loss_switch
    rows = [("a", "x", 5, 100, -30.0), ("a", "y", 1, 300, -80.0), ("a", "z", 9, 200, 20.0), ("b", "x", 1, 100, -10.0)]
    closed = spark.createDataFrame(rows, "book string, symbol string, exit_i long, exit_ms long, pnl double")
    start = spark.createDataFrame([("a", 0, 1000.0), ("b", 0, 1000.0)], "book string, day long, day_equity double")
    got = daily_loss_switch(closed, start, 0.05).collect()
    assert [(r.book, r.stopped_ms, r.realised) for r in got] == [("a", 300, -90.0)]


def test_t_limits():
    from tickloom.operators.studies import t_limits
    want = {1: 12.7062, 2: 4.30265, 3: 3.18245, 5: 2.57058, 10: 2.22814, 30: 2.04227}
    assert all(abs(t_limits()[df - 1] - v) < 5e-4 for df, v in want.items())


def test_an_order_that_cash_cannot_pay_is_refused(spark):
    from walks import walk_bars
    from tickloom.operators import outcomes as O
    from tickloom.operators.labels import Geometry
    from tickloom.operators import features as FE
    bars = spark.createDataFrame(walk_bars(200, 7)[["symbol", "ms", "open", "high", "low", "close", "volume"]])
    scored = FE.with_indicators(bars, "1h").selectExpr("*", "0.9D as p_long", "0.1D as p_short", "1 as side", "0.9D as p_side")
    count = lambda share: O.evaluate(scored, O.Rules(geometry=Geometry(1.5, 2.0, 12), position_pct=share)).count()
    assert count(0.9) > 0 and count(1.0) == 0


def test_upsert_reads_only_the_folders_it_touches(spark, tmp_path):
    from tickloom.sources import bar_store
    row = lambda s, ms, c: ("lab", f"{s}/USD", "1h", ms, 1.0, 1.0, 1.0, c, 1.0)
    from tickloom.schemas import BARS
    root = str(tmp_path / "bars")
    bar_store.save_bars(spark.createDataFrame([row(s, 0, 1.0) for s in "ab"], BARS), root)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("symbol_key=b*/*.parquet")}
    bar_store.upsert_bars(spark.createDataFrame([row("a", 0, 9.0), row("a", 3600000, 2.0)], BARS), root)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("symbol_key=b*/*.parquet")} == before and before
    got = sorted((r.symbol, r.ms, r.close) for r in bar_store.load_bars(spark, root).collect())
    assert got == [("a/USD", 0, 1.0), ("a/USD", 3600000, 2.0), ("b/USD", 0, 1.0)]
    rates = str(tmp_path / "rates")
    for rows in ([("a", 1, 0.1), ("b", 1, 0.2)], [("a", 1, 0.9), ("a", 2, 0.3)]):
        bar_store.upsert_rates(spark.createDataFrame(rows, "symbol string, ms long, rate double"), rates)
    assert sorted(tuple(r) for r in bar_store.load_rates(spark, rates).collect()) == [("a", 1, 0.1), ("a", 2, 0.3), ("b", 1, 0.2)]


def test_p_values_of_t(spark):
    """Against the finite sums for whole degrees of freedom."""
    import math
    from pyspark.sql import functions as F
    from tickloom.functions.statistics import t_p_value

    def exact(t, df):
        th = math.atan(abs(t) / math.sqrt(df))
        term, total = 1.0, 0.0
        if df % 2:
            term = math.cos(th)
            for k in range((df - 1) // 2):
                total += term
                term *= math.cos(th) ** 2 * (2 * k + 2) / (2 * k + 3)
            return 1 - 2 / math.pi * (th + math.sin(th) * total)
        for k in range(df // 2):
            total += term
            term *= math.cos(th) ** 2 * (2 * k + 1) / (2 * k + 2)
        return 1 - math.sin(th) * total

    rows = [(float(t), df) for df in range(1, 61) for t in (0, 0.01, -0.5, 1, 2.2, -5, 40)]
    frame = spark.createDataFrame(rows, "t double, df long").select("t", "df", t_p_value(F.col("t"), F.col("df")).alias("p"))
    for r in frame.collect():
        assert abs(r.p - exact(r.t, r.df)) < 1e-9, r
    none = spark.createDataFrame([(1.0, 0), (None, 3)], "t double, df long").select(t_p_value(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r.p for r in none] == [None, None]


def test_permuted_is_a_bijection(spark):
    from pyspark.sql import functions as F
    from tickloom.functions.permutation import permuted
    rows = [(n, key) for n in (1, 2, 3, 4, 5, 9, 10, 100, 257) for key in (0, 1, 77, 10 ** 11)]
    frame = spark.createDataFrame(rows, "n long, key long").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    got = frame.select("n", "key", "k", permuted(F.col("k"), F.col("n"), F.col("key")).alias("v")).collect()
    seen = {}
    for r in got:
        seen.setdefault((r.n, r.key), {})[r.k] = r.v
    assert all(sorted(v.values()) == list(range(n)) for (n, _), v in seen.items())
    moved = [v for (n, _), v in seen.items() if n == 257]
    assert all(sum(k == x for k, x in v.items()) < 12 for v in moved) and len({tuple(v.values()) for v in moved}) == len(moved)
