"""Vendor files to typed daily bars: nested chart JSON and daily CSV, any number of files per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import VENDOR_CHART

FIELDS = ("open", "high", "low", "close", "volume")


def parse_charts(raw: DataFrame) -> DataFrame:
    """Rows with a ``chart`` struct -> one bar per day of its first result; parallel arrays are zipped. A missing array is
    null for prices and 0 for the volume, a missing cell stays null, and rows without a close are dropped."""
    r = raw.withColumn("_r", F.get("chart.result", F.lit(0))).filter(F.col("_r").isNotNull())
    q = F.col("_r.indicators.quote")[0]
    count = F.size("_r.timestamp")
    absent = lambda f: F.lit(0.0 if f == "volume" else None).cast("double")
    filled = [F.when(F.size(q[f]) > 0, q[f]).otherwise(F.array_repeat(absent(f), count)).alias(f) for f in FIELDS]
    zipped = r.select(F.col("_r.meta.symbol").alias("symbol"), F.col("_r.timestamp").alias("seconds"), *filled)
    days = zipped.select("symbol", F.inline(F.arrays_zip("seconds", *FIELDS)))
    close = F.col("close")
    return days.filter(close.isNotNull() & F.col("seconds").isNotNull()).select(
        "symbol", F.to_date(F.timestamp_seconds("seconds")).alias("date"),
        *FIELDS)


def read_charts(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """Payloads one per line (splittable); ``pretty`` for one indented payload per file."""
    return parse_charts(spark.read.schema(VENDOR_CHART).option("multiLine", pretty).json(path))


def chart_errors(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """Payloads that carry an error or no result, counted by code."""
    raw = spark.read.schema(VENDOR_CHART).option("multiLine", pretty).json(path)
    bad = raw.filter(F.col("chart.result").isNull() | (F.size("chart.result") == 0))
    return bad.groupBy(F.coalesce("chart.error.code", F.lit("empty")).alias("code")).agg(F.count(F.lit(1)).alias("payloads"))


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily CSV with a case-insensitive header and optional volume; the symbol is the file name, or the folder's below
    ``symbol=...``.

    Columns are matched by each file's header, so files with and without volume mix in one read.
    """
    read = spark.read.text(path)
    symbol = F.col("symbol") if "symbol" in read.columns else F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")
    lines = read.select("value", F.col("_metadata.file_path").alias("file"), symbol.cast("string").alias("symbol"))
    heads = lines.filter(F.lower("value").startswith("date,"))
    names = heads.select("file", F.transform(F.split(F.lower("value"), ","), lambda c: F.trim(c)).alias("names")).dropDuplicates(["file"])
    body = lines.filter(~F.lower("value").startswith("date,") & (F.trim("value") != ""))
    cells = body.join(names, "file").withColumn("row", F.map_from_arrays("names", F.slice(F.split("value", ","), 1, F.size("names"))))
    value = lambda f: F.col(f"row.{f}").try_cast("double")
    return cells.select(
        "symbol", F.col("row.date").try_cast("date").alias("date"),
        *[value(f).alias(f) for f in FIELDS[:4]], F.coalesce(value("volume"), F.lit(0.0)).alias("volume")).filter(F.col("close").isNotNull())
