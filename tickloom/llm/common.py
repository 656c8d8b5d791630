"""Shared helpers of the text operators: tables, whole groups in Arrow batches, block pairs, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_owners: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back: no lineage, columnar and compressed.

    Inside :func:`folders` the folder belongs to the block around it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def no_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Queries inside give their shuffle files up when they end; none of them may be run a second time."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def folders(spark: SparkSession) -> Iterator[list[str]]:
    """Lists the folders that are written inside; :func:`remove` them when nothing reads them any more."""
    own: list[str] = []
    _owners.append(own)
    try:
        with no_shuffle_files(spark):
            yield own
    finally:
        _owners.remove(own)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders through Spark's file system and empties the list."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset, as in tests, one of this process's own."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        durable(spark.range(0).toDF())
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows and about 16 MB, so that long texts do not fill a Python worker."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")
    if not held.isdigit() or int(held) > 16 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold only whole groups of rows with equal ``keys``, and the row at which each group starts.

    The partition must be sorted by ``keys``. At most ``rows`` rows and one group are held.
    """
    def starts(part: pa.Table) -> np.ndarray:
        new = np.zeros(part.num_rows, bool)
        new[:1] = True
        for key in keys:
            values = part.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            held.append(piece)
            count += piece.num_rows
            if count < rows:
                continue
            part = pa.Table.from_batches(held)
            at_rows = starts(part)
            last = int(at_rows[-1])
            if last:
                yield part.slice(0, last), at_rows[:-1]
            held = part.slice(last).combine_chunks().to_batches()
            count = part.num_rows - last
    if count:
        part = pa.Table.from_batches(held)
        yield part, starts(part)


def list_values(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column (null lists are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def fixed_bytes(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Rows of a binary column of one width as a matrix."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(len(column), -1) if raw else np.zeros((len(column), 0), dtype)


def block_pairs(members: DataFrame, key: Sequence[str], node: str, size: Column, block: int) -> DataFrame:
    """Rows repeated for every pair of blocks (bi <= bj) of their group, so that each pair of members meets once.

    A group of at most ``block`` members stays one block pair (0, 0). Larger groups are dealt into blocks by a hash of
    the member, so no task gets more than two blocks whatever the group's size; ``mine`` says which block a row is in.
    """
    blocks = F.greatest(F.lit(1), F.ceil(size / F.lit(float(block)))).cast("int")
    dealt = members.withColumn("n_blocks", blocks).withColumn("mine", F.pmod(F.xxhash64(node), F.col("n_blocks")).cast("int"))
    every = F.when(F.col("n_blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return (
        dealt.withColumn("other", F.explode(every))
        .withColumn("bi", F.least("mine", "other")).withColumn("bj", F.greatest("mine", "other"))
        .drop("n_blocks", "other")
    )


def roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component inside one block pair."""
    label = np.arange(size)
    while left.size:
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        jump = label[label]
        while not np.array_equal(jump, label):
            label, jump = jump, jump[jump]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest reachable node) for undirected ``a, b`` edges of long ids.

    Alternates large-star and small-star steps until the edges stop changing. Each step is one join, which a hub cannot
    hold up, and two pre-aggregated shuffles; only a count and a checksum come back to the driver. The result is checkpointed.
    Null ends and self loops are ignored; no edges give no rows.
    """
    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
        # Written, so that the join has its own exchange on either side and a node with very many links can be split.
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        joined = both.join(low, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def state(links: DataFrame) -> tuple:
        row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    links = durable(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    seen = state(links)
    for _ in range(most_rounds if seen[0] else 0):
        links = durable(star(star(links, True), False))
        now = state(links)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
