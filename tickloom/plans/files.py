"""Sources and sinks exercised end to end on tables derived from the driver's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.timeframes import to_ts
from tickloom.operators import bars as B
from tickloom.plans import inputs
from tickloom.plans.common import TICKS, bars_cte, rounded, to_ts_sql
from tickloom.plans.streams import scratch
from tickloom.schemas import ALERTS, BARS, EQUITY, HISTORY, STATE, names
from tickloom.sources import bar_store, journals, vendor

QUERIES: dict = {}
ORACLE: dict = {}
BASE = f"WITH {TICKS}, {bars_cte('1h')}"
CUT = 1705338000000


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def stored_rows(spark, sf):
    b = inputs.bars(spark, sf)
    return b.select(F.lit("lab").alias("exchange"), F.concat("symbol", F.lit("/USD")).alias("symbol"), F.lit("1h").alias("timeframe"), "ms",
                    *[F.col(c).cast("double").alias(c) for c in B.OHLCV]).select(*names(BARS))


@query("bar_store", f"""{BASE} SELECT symbol || '/USD' AS symbol, {to_ts_sql('ms')} AS ts, close + CASE WHEN ms >= {CUT} THEN 1000 ELSE 0 END AS close FROM bars WHERE symbol IN ('click', 'error')""")
def bar_store_round_trip(spark, sf):
    """Save, upsert overlapping bars (stored ones win), read two symbols back."""
    root, rows = scratch(spark, "store"), stored_rows(spark, sf)
    bar_store.save_bars(rows.filter(F.col("ms") < CUT), root)
    late = rows.filter(F.col("ms") >= CUT - 86_400_000).withColumn("close", F.col("close") + 1000)
    bar_store.upsert_bars(late, root)
    out = bar_store.load_bars(spark, root, ["click/USD", "error/USD"], "lab", "1h")
    return B.with_ts(out).select("symbol", "ts", "close")


@query("rate_store", """WITH r AS (SELECT epoch_us(ts) // 1000 AS ms, max(value / 100000.0::double) AS rate FROM events WHERE event_type = 'signup' AND event_id % 7 = 0 GROUP BY 1), s AS (SELECT DISTINCT event_type AS symbol FROM events)
SELECT symbol, count(*) AS n, round(sum(rate), 8) AS total FROM r, s GROUP BY symbol""")
def rate_store(spark, sf):
    root, rates = scratch(spark, "rates"), inputs.rates(spark, sf)
    bar_store.upsert_rates(rates.filter(F.col("ms") % 2 == 0), root)
    bar_store.upsert_rates(rates.withColumn("rate", F.when(F.col("ms") % 2 == 0, -1.0).otherwise(F.col("rate"))), root)
    return bar_store.load_rates(spark, root).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate"), 8).alias("total"))


DAILY = "d AS (SELECT symbol, ms - ms % 86400000 AS day, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2)"


@query("vendor_charts", f"WITH {TICKS}, {DAILY} SELECT symbol, make_timestamp(day * 1000)::date AS date, open, high, low, close, volume::double AS volume FROM d WHERE low > 0.02")
def vendor_charts(spark, sf):
    """Daily bars written as nested vendor payloads (one per symbol and month) and parsed back."""
    d = inputs.bars(spark, sf, "1d")
    keep = F.when(F.col("low") > 0.02, F.col("close"))  # the vendor leaves holes
    d = d.withColumn("close", keep).withColumn("page", F.floor(F.col("ms") / 864_000_000))
    gather = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("ms", F.struct(F.col(c).cast("double").alias("v"))))), lambda x: x[f"col2"]["v"])
    # ten days per payload
    pages = d.groupBy("symbol", "page").agg(
        F.transform(F.sort_array(F.collect_list("ms")), lambda m: (m / 1000).cast("long")).alias("seconds"), *[gather(c).alias(c) for c in B.OHLCV])
    quote = F.array(F.struct(*[F.col(c).alias(c) for c in B.OHLCV]))
    result = F.array(F.struct(F.struct(F.col("symbol").alias("symbol")).alias("meta"), F.col("seconds").alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators")))
    path = scratch(spark, "charts")
    pages.select(F.to_json(F.struct(F.struct(result.alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return vendor.read_charts(spark, path)


@query("daily_csv", f"WITH {TICKS}, {DAILY} SELECT symbol, make_timestamp(day * 1000)::date AS date, open, high, low, close, CASE WHEN symbol IN ('click', 'error') THEN 0.0::double ELSE volume::double END AS volume FROM d")
def daily_csv(spark, sf):
    """All symbols' daily files, a folder per symbol and a header per file, some without a volume."""
    path, d = scratch(spark, "csv"), inputs.bars(spark, sf, "1d")
    cells = [F.to_date(to_ts("ms")).alias("DATE"), F.col("open").alias("Open"), F.col("high").alias("HIGH"), "low", F.col("close").alias("Close")]
    bare = F.col("symbol").isin("click", "error")
    for rows in (d.filter(bare).select("symbol", *cells), d.filter(~bare).select("symbol", *cells, F.col("volume").alias("Volume"))):
        rows.write.mode("append").partitionBy("symbol").option("header", True).csv(path)
    return vendor.read_daily_csv(spark, path)


@query("chart_errors", "SELECT CASE WHEN event_id % 3 = 1 THEN 'Not Found' ELSE 'empty' END AS code, count(*) AS payloads FROM events WHERE event_id % 3 > 0 GROUP BY 1")
def chart_errors(spark, sf):
    """Payloads with a result, with an error, and with neither, told apart."""
    path = scratch(spark, "errors")
    good = F.lit('{"chart":{"result":[{"meta":{"symbol":"x"},"timestamp":[1],"indicators":{"quote":[{"close":[1.0]}]}}],"error":null}}')
    bad = F.lit('{"chart":{"result":null,"error":{"code":"Not Found"}}}')
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, good).when(kind == 1, bad).otherwise(F.lit('{"chart":{"result":[],"error":null}}'))
    inputs.table(spark, sf, "events").select(text.alias("value")).write.text(path)
    return vendor.chart_errors(spark, path)


@query("journal_books", f"{BASE} SELECT CASE WHEN symbol = 'click' THEN 'default' ELSE symbol END AS book, count(*) AS n, round(sum(close), 6) AS total FROM bars WHERE symbol <> 'view' GROUP BY 1")
def journal_books(spark, sf):
    """One equity journal per book folder; the root is the default book, 'portfolio' is left out."""
    root = scratch(spark, "runtime")
    rows = inputs.bars(spark, sf).select("ms", F.lit(0).cast("long").alias("seq"), "symbol", "close", F.col("close").alias("equity"))
    journals.append_journal(rows.filter("symbol <> 'click'").withColumn("book", F.when(F.col("symbol") == "view", "portfolio").otherwise(F.col("symbol"))), root, "book")
    journals.append_journal(rows.filter("symbol = 'click'"), root)
    schema = EQUITY.removeprefix("book string, ")
    out = journals.load_books(spark, root, "*.json", schema)
    return rounded(out.groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total")))


@query("state_latest", f"WITH {TICKS} SELECT symbol AS book, max(ms) AS updated_ms, round(last(price ORDER BY ts, event_id), 6) AS equity FROM ticks GROUP BY symbol")
def state_latest(spark, sf):
    path, t = scratch(spark, "state"), inputs.ticks(spark, sf)
    for half in (t.filter(F.col("ms") < CUT), t):
        snap = half.groupBy(F.col("symbol").alias("book")).agg(F.max("ms").alias("updated_ms"), F.max_by("price", F.struct("ts", "event_id")).alias("equity"))
        journals.save_state(snap, path)
    return rounded(journals.load_state(spark, path, STATE).select("book", "updated_ms", "equity"))


@query("last_alert", f"WITH {TICKS} SELECT symbol AS book, max(ms) AS ms FROM ticks WHERE event_id % 3 = 0 GROUP BY symbol")
def last_alert(spark, sf):
    """Alerts with malformed lines in between."""
    path = scratch(spark, "alerts")
    t = inputs.ticks(spark, sf).select(F.col("symbol").alias("book"), "ms", F.when(F.col("event_id") % 3 == 0, "drawdown").otherwise("connection").alias("kind"))
    text = journals.records(t).select(F.explode(F.array("record", F.concat(F.lit("{broken "), "record"), F.lit(""))).alias("value"))
    text.write.text(path)
    return journals.last_alert(journals.load_journal(spark, path, ALERTS), "drawdown").select("book", "ms")


@query("experiment_log", f"WITH {TICKS} SELECT symbol AS name, count(*)::double AS trades, round(avg(price), 6) AS ret FROM ticks GROUP BY symbol")
def experiment_log(spark, sf):
    path = scratch(spark, "experiments")
    t = inputs.ticks(spark, sf).groupBy(F.col("symbol").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("trades"), F.avg("price").alias("ret"))
    journals.log_experiment(t.select("name", F.struct(F.struct("trades", "ret").alias("oos")).alias("metrics")), path)
    schema = "name string, metrics struct<oos:struct<trades:double,ret:double>>"
    flat = journals.flatten(spark.read.schema(schema).json(path))
    return rounded(flat.withColumnsRenamed({"metrics_oos_trades": "trades", "metrics_oos_ret": "ret"}))


@query("config_history", "SELECT ts AS timestamp, event_type AS field, user_id::varchar AS new FROM events ORDER BY ts DESC LIMIT 30")
def config_history(spark, sf):
    path = scratch(spark, "history")
    e = inputs.table(spark, sf, "events")
    journals.append_journal(e.select(F.col("ts").cast("timestamp").alias("timestamp"), F.lit("risk").alias("scope"), F.col("event_type").alias("field"), F.col("user_id").cast("string").alias("new")), path)
    rows = journals.latest_rows(journals.load_journal(spark, path, HISTORY), 30, "timestamp")
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "field", "new")


@query("report_newest", f"WITH {TICKS} SELECT symbol, count(*) AS n, '20240202_101500' AS stamp FROM ticks GROUP BY symbol")
def report_newest(spark, sf):
    root = scratch(spark, "reports")
    t = inputs.ticks(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    paths = [journals.write_report(t.filter(F.lit(k > 0)), root, "screen", stamp) for k, stamp in enumerate(("20240101_090000", "20240202_101500"))]
    newest = journals.newest_report(spark.createDataFrame([(p,) for p in paths], "path string"), "screen").first()
    return spark.read.schema("symbol string, n long, stamp string").option("header", True).csv(newest.path)
