"""Streams over the event files: run to the end of the available data, then read the sink."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans import inputs
from tickloom.plans.common import TICKS, bars_cte, to_ts_sql
from tickloom.plans.trading import signals
from tickloom.streaming import bars as SB
from tickloom.streaming import tracker as ST

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (a private one only on a local master)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, mode: str = "append", newest: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Process what is there, journal each batch under its id, hand back the journal.

    In update mode a key comes again with every batch that touches it: ``newest`` names the key columns, and only each
    key's last row is handed back. With the ``out`` folder of an earlier run the stream goes on where that one stopped.
    """
    spark = stream.sparkSession
    out = out or scratch(spark, name)
    q = (stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
         .foreachBatch(SB.append_once(f"{out}/data")).start())
    q.awaitTermination()
    rows = spark.read.schema(f"{stream.schema.toDDL()}, batch_id long").parquet(f"{out}/data")
    if newest:
        rest = [c for c in stream.columns if c not in newest]
        rows = rows.groupBy(*newest).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row")).select(*newest, "_row.*")
    return rows.select(*stream.columns)


def tick_stream(spark: SparkSession, sf: str) -> DataFrame:
    inputs.prepare(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


def ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


BASE = f"WITH {TICKS}, {bars_cte('1h')}"


@query("stream_bars", f"{BASE} SELECT symbol, {to_ts_sql('ms')} AS ts, open, high, low, close, volume FROM bars WHERE ms + 3600000 <= (SELECT max(ms) FROM ticks)")
def stream_bars(spark, sf):
    return ntz(run_available(SB.closed_bars(tick_stream(spark, sf), "1h"), "bars"), "ts")


@query("stream_dedup", f"WITH {TICKS} SELECT DISTINCT symbol, {to_ts_sql('ms - ms % 3600000')} AS ts FROM ticks")
def stream_dedup(spark, sf):
    hours = tick_stream(spark, sf).select("symbol", F.date_trunc("hour", "ts").alias("ts"))
    return ntz(run_available(SB.new_bars_only(hours, "1 hour"), "dedup"), "ts")


@query("stream_prices", f"WITH {TICKS} SELECT symbol, last(price ORDER BY ts, event_id) AS price, max(ts) AS ts FROM ticks GROUP BY symbol")
def stream_prices(spark, sf):
    return ntz(run_available(SB.latest_prices(tick_stream(spark, sf)), "prices", "update", ["symbol"]), "ts")


@query("stream_variants", f"{BASE} SELECT symbol, {to_ts_sql('ms - ms % 86400000')} AS ts, v AS variant, coalesce(t, 0.55)::double AS threshold, count(*) AS n FROM ticks, (VALUES ('a', NULL), ('b', 0.6)) x(v, t) GROUP BY ALL")
def stream_variants(spark, sf):
    variants = spark.createDataFrame([("a", None), ("b", 0.6)], "variant string, threshold double")
    fan = SB.fan_out(tick_stream(spark, sf), variants, {"threshold": 0.55})
    out = run_available(fan.select("symbol", F.date_trunc("day", "ts").alias("ts"), "variant", "threshold"), "variants")
    return ntz(out.groupBy("symbol", "ts", "variant", "threshold").agg(F.count(F.lit(1)).alias("n")), "ts")


@query("stream_gap_alarms", f"""WITH {TICKS}, d AS (SELECT DISTINCT symbol, ms FROM ticks), g AS (SELECT *, lag(ms) OVER (PARTITION BY symbol ORDER BY ms) AS p FROM d), l AS (SELECT symbol, max(ms) AS m FROM d GROUP BY symbol)
SELECT symbol, 'outage' AS kind, {to_ts_sql('p + 1800000')} AS at, NULL::bigint AS missing FROM g WHERE ms - p > 1800000
UNION ALL SELECT symbol, 'recovery', {to_ts_sql('ms')}, (ms - p) // 900000 - 1 FROM g WHERE ms - p > 1800000
UNION ALL SELECT symbol, 'outage', {to_ts_sql('m + 1800000')}, NULL FROM l WHERE m + 2700000 < (SELECT max(ms) FROM d)""")
def stream_gap_alarms(spark, sf):
    return ntz(run_available(SB.gap_alarms(tick_stream(spark, sf).select("symbol", "ts"), "15m"), "alarms"), "at")


def bar_stream(spark, sf) -> DataFrame:
    """Scored hourly bars written once and read back as a stream."""
    path = scratch(spark, "scored")
    cols = signals(spark, sf).select("symbol", F.timestamp_millis("ms").alias("ts"), "open", "high", "low", "close", "atr", "p_long", "p_short")
    cols.write.parquet(path)
    return spark.readStream.schema(cols.schema).parquet(path)


@query("stream_tracker")
def stream_tracker(spark, sf):
    variants = spark.createDataFrame([("a", None), ("b", 0.9)], "variant string, threshold double")
    bars = SB.fan_out(bar_stream(spark, sf), variants, {"threshold": 0.8}).filter("atr is not null")
    return ntz(run_available(ST.track_positions(bars), "positions"), "ts")


@query("stream_recent_bars", f"""{BASE}, k AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ms DESC) <= 50)
SELECT symbol, count(*) AS bars, min(ms) AS first_ms, max(ms) AS last_ms, round(avg(close), 6) AS mean_close FROM k GROUP BY symbol""")
def stream_recent_bars(spark, sf):
    out = run_available(ST.recent_bars(bar_stream(spark, sf), 50), "recent", "update", ["symbol"])
    return out.withColumn("mean_close", F.round("mean_close", 6))


@query("stream_drawdown", f"""WITH {TICKS}, e AS (SELECT symbol AS book, ts, event_id, price + 100 AS equity FROM ticks), d AS (SELECT *, equity / max(equity) OVER w - 1 AS dd, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY book ORDER BY ts ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, coalesce(last_value(CASE WHEN dd <= -0.3 THEN 1 WHEN dd > -0.15 THEN 0 END IGNORE NULLS) OVER w, 0) AS st FROM d WINDOW w AS (PARTITION BY book ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT book, ts, round(dd, 6) AS drawdown FROM (SELECT *, coalesce(lag(st) OVER (PARTITION BY book ORDER BY ts), 0) AS was FROM m) WHERE st = 1 AND was = 0""")
def stream_drawdown(spark, sf):
    equity = tick_stream(spark, sf).select(F.col("symbol").alias("book"), "ts", (F.col("price") + 100).alias("equity"))
    out = run_available(ST.drawdown_alarms(equity, 0.3), "drawdown")
    return ntz(out, "ts").withColumn("drawdown", F.round("drawdown", 6))


@query("stream_daily_loss", f"""WITH {TICKS}, p AS (SELECT symbol AS book, ts, ms // 86400000 AS day, 45 - price AS pnl, event_id FROM ticks),
d AS (SELECT book, day, 10000 + coalesce(sum(sum(pnl)) OVER (PARTITION BY book ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS equity FROM p GROUP BY book, day),
r AS (SELECT p.*, equity, sum(pnl) OVER (PARTITION BY p.book, p.day ORDER BY ts ROWS UNBOUNDED PRECEDING) AS realised FROM p JOIN d ON d.book = p.book AND d.day = p.day)
SELECT book, min(ts) AS ts, round(arg_min(realised, ts), 6) AS realised FROM r WHERE realised <= -0.05::double * equity GROUP BY book, day""")
def stream_daily_loss(spark, sf):
    trades = tick_stream(spark, sf).select(F.col("symbol").alias("book"), "ts", (45 - F.col("price")).alias("pnl"))
    out = run_available(ST.daily_loss_alarms(trades, 0.05, 10_000.0), "loss")
    return ntz(out, "ts").withColumn("realised", F.round("realised", 6))
