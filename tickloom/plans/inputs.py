"""The driver's tables seen as market data: ticks, bars, rates, scores, price panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.timeframes import epoch_ms
from tickloom.operators.bars import ticks_to_bars
from tickloom.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("symbol"), "ts", epoch_ms("ts").alias("ms"), F.col("value").alias("price"), "event_id"
    )


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), timeframe)


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular settlements, the same series for every symbol: every 7th signup event."""
    events = table(spark, sf_dir, "events").filter("event_type = 'signup' and event_id % 7 = 0")
    series = events.groupBy(epoch_ms("ts").alias("ms")).agg(F.max(F.col("value") / 100000.0).alias("rate"))
    symbols = table(spark, sf_dir, "events").agg(F.collect_set("event_type").alias("_symbols"))  # one row: the board
    return series.crossJoin(F.broadcast(symbols)).select(F.explode("_symbols").alias("symbol"), "ms", "rate")


def hashed(*parts: Column) -> Column:
    """Deterministic value in [0, 1) that any engine with md5 can reproduce."""
    digest = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def scored(df: DataFrame) -> DataFrame:
    """Two deterministic probabilities per bar."""
    return df.withColumns({
        "p_long": hashed(F.lit("L"), F.col("symbol"), F.col("ms")),
        "p_short": hashed(F.lit("S"), F.col("symbol"), F.col("ms")),
    })


def panel25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price per brand: revenue over quantity of the lines shipped that day.

    Lines combine to (part, day) before the join, so a part on a third of all lines costs one row
    per day; money is summed in cents and quantity in units, which keeps the sums exact.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("date")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum(F.col("l_quantity").cast("long")).alias("units"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy(F.col("p_brand").alias("symbol"), "date")
        .agg((F.sum("cents") / 100.0 / F.sum("units")).alias("close"))
    )


def panel5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price per order priority: mean order value."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")
    ).agg((F.sum(cents) / 100.0 / F.count(F.lit(1))).alias("close"))
