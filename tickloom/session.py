"""Session helpers: settings, durable cut points."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHUNK_ROWS_CONF = "spark.tickloom.chunkRows"
DEFAULT_CHUNK_ROWS = 1 << 16


def local_session(cpus: int | str = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and for the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on: wall-clock timestamps are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def chunk_rows(spark: SparkSession) -> int:
    """Rows of one key handled by one window task (tests shrink it to cross chunk borders)."""
    return int(spark.conf.get(CHUNK_ROWS_CONF, str(DEFAULT_CHUNK_ROWS)))


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    A lost executor re-reads the files, so values that depend on a sampled range partitioning
    stay the same afterwards. Only a local master may fall back to a private folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
