"""Bar and rate tables on disk: Hive-partitioned Parquet, merged per partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import path_safe
from tickloom.operators.bars import merge_keep_existing
from tickloom.schemas import BARS, RATES, names
from tickloom.session import durable

BAR_LAYOUT = ("exchange", "timeframe", "symbol_key")


def _read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Stored table, or an empty one with the right columns when nothing was stored yet."""
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_bars(spark: SparkSession, root: str, symbols: Sequence[str] | None = None, exchange: str | None = None,
              timeframe: str | None = None) -> DataFrame:
    """Bars; the filters on exchange, timeframe and symbol prune directories."""
    bars = _read(spark, root, f"{BARS}, symbol_key string")
    if exchange:
        bars = bars.filter(F.col("exchange") == exchange)
    if timeframe:
        bars = bars.filter(F.col("timeframe") == timeframe)
    if symbols is not None:
        keys = [s.replace("/", "-").replace(":", "_") for s in symbols]
        bars = bars.filter(F.col("symbol_key").isin(keys) & F.col("symbol").isin(list(symbols)))
    return bars.drop("symbol_key")


def save_bars(bars: DataFrame, root: str, rows_per_file: int = 5_000_000) -> None:
    """Deduplicate on the key and replace the partitions the rows fall into.

    A hot symbol is spread over time-ranged files instead of one writer task.
    """
    unique = merge_keep_existing(bars, bars.limit(0), ("exchange", "symbol", "timeframe", "ms"))
    keyed = unique.select(*names(BARS)).withColumn("symbol_key", path_safe("symbol"))
    ranged = keyed.repartitionByRange(*BAR_LAYOUT, "ms").sortWithinPartitions(*BAR_LAYOUT, "ms")
    (ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
     .partitionBy(*BAR_LAYOUT).parquet(root))


def upsert_bars(incoming: DataFrame, root: str) -> None:
    """Add new bars; a stored bar wins. Only the touched partitions are read and rewritten."""
    spark = incoming.sparkSession
    # Joined on the folders; the comparison tells Spark that this side is selective, so that it prunes them at run time.
    touched = incoming.select("exchange", "timeframe", path_safe("symbol").alias("symbol_key")).distinct().filter(F.col("symbol_key") > "")
    stored = _read(spark, root, f"{BARS}, symbol_key string").join(touched, list(BAR_LAYOUT), "left_semi").drop("symbol_key")
    merged = merge_keep_existing(stored, incoming, ("exchange", "symbol", "timeframe", "ms"))
    save_bars(durable(merged), root)  # the write replaces files the merge reads


def load_rates(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, f"{RATES}, symbol_key string").drop("symbol_key")


def upsert_rates(incoming: DataFrame, root: str) -> None:
    """Add new rates; a stored rate wins. Only the folders of the incoming symbols are read and rewritten."""
    spark = incoming.sparkSession
    touched = incoming.select(path_safe("symbol").alias("symbol_key")).distinct().filter(F.col("symbol_key") > "")
    stored = _read(spark, root, f"{RATES}, symbol_key string").join(touched, "symbol_key", "left_semi").drop("symbol_key")
    merged = durable(merge_keep_existing(stored, incoming.select(*names(RATES)))).withColumn("symbol_key", path_safe("symbol"))
    (merged.repartitionByRange("symbol_key", "ms").sortWithinPartitions("symbol_key", "ms").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("symbol_key").parquet(root))
