"""Diversification screen: monthly correlation with a benchmark and what it tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import diversification_verdict, ratio

MIN_MONTHS = 60
ROLL_MONTHS = 36


def monthly_returns(panel: DataFrame) -> DataFrame:
    """Month-end returns per symbol; a month without a price carries the last one."""
    ends = panel.filter(F.col("close").isNotNull()).groupBy("symbol", F.trunc("date", "month").alias("month")).agg(
        F.max_by("close", "date").alias("close"))
    span = panel.agg(F.sequence(F.trunc(F.min("date"), "month"), F.trunc(F.max("date"), "month"), F.expr("interval 1 month")).alias("_months"))
    grid = ends.select("symbol").distinct().crossJoin(F.broadcast(span)).select("symbol", F.explode("_months").alias("month"))
    w = W.partitionBy("symbol").orderBy("month")
    full = grid.join(ends, ["symbol", "month"], "left").withColumn(
        "close", F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return full.withColumn("ret", ratio("close", F.lag("close").over(w)) - 1.0).filter(F.col("ret").isNotNull()).select("symbol", "month", "ret")


def pairs_with_benchmark(monthly: DataFrame, benchmark: str) -> DataFrame:
    bench = monthly.filter(F.col("symbol") == benchmark).select("month", F.col("ret").alias("bench"))
    return monthly.filter(F.col("symbol") != benchmark).join(bench, "month")


def rolling_correlation(pairs: DataFrame, months: int = ROLL_MONTHS) -> DataFrame:
    """Correlation over the last ``months`` common months; a symbol has one row per month."""
    frame = W.partitionBy("symbol").orderBy("month").rowsBetween(-(months - 1), 0)
    return pairs.withColumn("roll", F.when(F.count("ret").over(frame) == months, F.corr("ret", "bench").over(frame)))


def screen(panel: DataFrame, benchmark: str, years: int = 10, as_of: str | None = None, min_months: int = MIN_MONTHS) -> DataFrame:
    """One row per candidate, most different from the benchmark first."""
    if as_of is not None:
        panel = panel.filter(F.col("date") < F.lit(as_of).cast("date"))
    newest = panel.agg(F.max("date").alias("_max"))
    recent = panel.crossJoin(F.broadcast(newest)).filter(F.col("date") >= F.add_months("_max", -12 * years)).drop("_max")
    rolled = rolling_correlation(pairs_with_benchmark(monthly_returns(recent), benchmark))
    n = F.count(F.lit(1))
    agg = rolled.groupBy("symbol").agg(
        F.corr("ret", "bench").alias("corr"), F.min("roll").alias("roll_min"), F.max("roll").alias("_roll_max"),
        ((F.pow(F.product(1.0 + F.col("ret")), 12.0 / n) - 1.0) * 100.0).alias("cagr_pct"), n.alias("months"))
    agg = agg.filter(F.col("months") >= min_months).withColumn("roll_max", F.coalesce("_roll_max", "corr")).drop("_roll_max")
    out = agg.withColumn("verdict", diversification_verdict("corr", "roll_max", "cagr_pct"))
    if as_of is not None:
        out = out.withColumn("as_of", F.lit(as_of).cast("date"))
    return out.orderBy("corr")


def screen_counts(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count(F.lit(1)).alias("screened"), F.count_if(F.col("corr") < 0).alias("negatives"),
        F.count_if(F.col("verdict") == "candidate").alias("candidates"),
        F.count_if((F.col("corr") < 0) & (F.col("cagr_pct") > 0)).alias("negative_and_earning"))
