"""Streams fed in several files give what one batch gives."""

import datetime
import tempfile
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from walks import atr, walk_bars

from tickloom.plans.streams import run_available
from tickloom.streaming import bars as SB
from tickloom.streaming import tracker as ST


def files(spark, pdf, parts):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k, chunk in enumerate(np.array_split(pdf, parts)):
        spark.createDataFrame(chunk).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = spark.createDataFrame(pdf).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def bars_frame():
    pdf = walk_bars(150, 31)
    pdf["atr"] = atr(pdf)
    pdf["ts"] = pd.to_datetime(pdf.ms, unit="ms", utc=True).dt.tz_localize(None)
    pdf["variant"], pdf["threshold"] = "a", 0.7
    return pdf.dropna()


def test_tracker_state_survives_batches(spark):
    pdf = bars_frame()
    got = run_available(ST.track_positions(files(spark, pdf, 5), horizon=9), "t").toPandas().sort_values("ts", kind="stable")
    pos = dict(last_ms=-1, seen=0, side=0, entry=0.0, tp=0.0, sl=0.0, deadline=0)
    want = [(bar.ts, *e) for bar in pdf.itertuples() for e in ST.step_position(pos, bar, 1.5, 2.0, 9, 0.7, True)]
    key = lambda rows: sorted((str(r[0]), r[1], int(r[2]), round(r[3], 6)) for r in rows)
    assert key(zip(got.ts, got.event, got.side, got.price)) == key(want)
    assert {"open", "tp", "sl"} <= set(got.event)


def test_late_and_repeated_bars_are_ignored(spark):
    pdf = bars_frame()
    again = pd.concat([pdf, pdf.head(40)], ignore_index=True)
    one = run_available(ST.recent_bars(files(spark, pdf, 1), 30), "r", "update").toPandas()
    two = run_available(ST.recent_bars(files(spark, again, 3), 30), "r", "update").orderBy(F.desc("last_ms")).toPandas()
    assert one.iloc[0].last_ms == two.last_ms.max() and two.bars.max() == 30


def test_gap_alarm_opens_and_recovers(spark):
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-01 06:00", "2024-01-01 07:00"])
    pdf = pd.DataFrame({"symbol": "A", "ts": ts})
    got = run_available(SB.gap_alarms(files(spark, pdf, 1), "1h"), "g").toPandas().sort_values("at")
    assert got.kind.tolist()[:2] == ["outage", "recovery"] and int(got.missing.dropna().iloc[0]) == 4


def test_mark_to_market_values_books(spark):
    seen = []
    holdings = spark.createDataFrame([("b", "A", 2.0), ("b", "B", 1.0)], "book string, symbol string, qty double")
    prices = spark.createDataFrame([("A", 5.0, 1), ("B", 7.0, 1)], "symbol string, price double, ts int")
    SB.mark_to_market(holdings, lambda df, k: seen.append(df.first().value))(prices, 0)
    assert seen == [17.0]


def _files(spark, tmp_path, rows, schema, count):
    """The rows as ``count`` files in the order of time, read one file per trigger."""
    folder = str(tmp_path / f"in{count}")
    size = -(-len(rows) // count)
    for k in range(count):
        part = spark.createDataFrame(rows[k * size:(k + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(folder)
        time.sleep(0.02)  # the source takes files by modification time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


START = datetime.datetime(2024, 1, 1)


def _walk(n=210):
    rng = np.random.default_rng(3)
    steps = rng.normal(0, 6, (n, 2))
    return [(s, START + datetime.timedelta(minutes=37 * k), float(100 + steps[:k + 1, j].sum()), k * 2 + j) for k in range(n) for j, s in enumerate("ab")]


@pytest.mark.parametrize("files", [1, 3, 7])
def test_update_streams_hand_back_the_newest_row_per_key(spark, tmp_path, files):
    rows = _walk()
    ticks = _files(spark, tmp_path, rows, "symbol string, ts timestamp, price double, event_id long", files)
    prices = {r.symbol: (r.price, r.ts) for r in run_available(SB.latest_prices(ticks), "prices", "update", ["symbol"]).collect()}
    assert prices == {s: (p, t) for s, t, p, _ in rows}
    bars = ticks.select("symbol", "ts", F.col("price").alias("close"))
    recent = run_available(ST.recent_bars(bars, 50), "recent", "update", ["symbol"]).collect()
    for r in recent:
        own = [(t, p) for s, t, p, _ in rows if s == r.symbol][-50:]
        assert r.bars == 50 and r.last_ms == int(own[-1][0].timestamp() * 1000) and abs(r.mean_close - np.mean([p for _, p in own])) < 1e-9
    assert len(recent) == 2


@pytest.mark.parametrize("files", [1, 3, 7])
def test_alarms_do_not_depend_on_the_number_of_files(spark, tmp_path, files):
    rows = _walk()
    ticks = _files(spark, tmp_path, rows, "symbol string, ts timestamp, price double, event_id long", files)
    book = F.col("symbol").alias("book")
    drops = run_available(ST.drawdown_alarms(ticks.select(book, "ts", F.col("price").alias("equity")), 0.2), "drops").collect()
    want = []
    for s in "ab":
        peak, alarmed = 0.0, False
        for _, t, p, _ in (r for r in rows if r[0] == s):
            peak = max(peak, p)
            dd = p / peak - 1
            if dd <= -0.2 and not alarmed:
                want.append((s, t, round(dd, 9)))
                alarmed = True
            elif dd > -0.1:
                alarmed = False
    assert sorted((r.book, r.ts, round(r.drawdown, 9)) for r in drops) == sorted(want) and want
    pnl = F.col("price") - 100
    alerts = run_available(ST.daily_loss_alarms(ticks.select(book, "ts", pnl.alias("pnl")), 0.05, 1000.0), "loss").collect()
    want = []
    for s in "ab":
        equity, day, realised, alerted = 1000.0, None, 0.0, False
        for _, t, p, _ in (r for r in rows if r[0] == s):
            if t.date() != day:
                equity, day, realised, alerted = equity + realised, t.date(), 0.0, False
            realised += p - 100
            if realised <= -0.05 * equity and not alerted:
                want.append((s, t))
                alerted = True
    assert sorted((r.book, r.ts) for r in alerts) == sorted(want) and want


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "symbol string, ts timestamp, close double"
    rows = [(s, t, p) for s, t, p, _ in _walk(60)]
    folder, out = str(tmp_path / "grow"), str(tmp_path / "out")
    for part in (rows[:70], rows[70:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        got = run_available(ST.recent_bars(stream, 1000), "grow", "update", ["symbol"], out=out)
    assert {r.symbol: r.bars for r in got.collect()} == {"a": 60, "b": 60}
