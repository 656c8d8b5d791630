"""Append-only JSON journals, state snapshots, reports and experiment logs."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def load_journal(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped, a missing journal is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("timestampFormat", MICROS).json(glob)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_journal(rows: DataFrame, path: str, book: str | None = None) -> None:
    """Appends rows; a ``book`` column parts them into a folder each, in one job."""
    writer = rows.write.mode("append").option("timestampFormat", MICROS)
    (writer.partitionBy(book) if book else writer).json(path)


def records(df: DataFrame) -> DataFrame:
    """Rows as JSON text without cells the row does not have."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))


def load_books(spark: SparkSession, root: str, file: str, schema: str) -> DataFrame:
    """The same journal of every book below ``root``: sub-folder (``name`` or ``book=name``) = book, root itself = default.

    The portfolio folder holds another kind of book and is left out.
    """
    # a reader with a glob for both depths; the book comes from the file's own path
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", file).json(root)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    tagged = rows.withColumn("book", F.when(folder == base, "default").otherwise(F.regexp_replace(folder, "^book=", "")))
    return tagged.filter(F.col("book") != "portfolio")


_POINTER = "current-"


def _listed(spark: SparkSession, path: str):
    """The folder's file system, its Hadoop path and the names in it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, root, sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []


def _current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number of the newest pointer and the generation that the newest complete one names; (0, None) before the first save."""
    fs, root, names = _listed(spark, path)
    pointers = [n for n in names if n.startswith(_POINTER)]
    for pointer in reversed(pointers):
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(root, pointer))
        generation = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if generation in names:
            return int(pointers[-1].removeprefix(_POINTER)), f"{path}/{generation}"
    return (int(pointers[-1].removeprefix(_POINTER)) if pointers else 0), None


def save_state(state: DataFrame, path: str, key: str = "book", at: str = "updated_ms") -> None:
    """Merges a snapshot into the newest row per key and makes the result the current generation.

    The merged rows go into a folder of their own; then a pointer, a numbered file that names the folder, is created,
    which is what readers go by. A save that ends before that leaves the old generation current. A number can be taken
    once, so of two writers at a time the later fails. The generation before stays for readers that are under way; older
    ones, and what broken saves have left, are removed.
    """
    spark = state.sparkSession
    number, before = _current(spark, path)
    merged = state if before is None else state.unionByName(spark.read.schema(state.schema).json(before))
    generation = f"gen{number + 1:010d}_{uuid.uuid4().hex}"
    latest_state(merged, key, at).write.json(f"{path}/{generation}")
    fs, root, names = _listed(spark, path)
    child = lambda name: spark._jvm.org.apache.hadoop.fs.Path(root, name)
    try:
        pointer = fs.create(child(f"{_POINTER}{number + 1:010d}"), False)
    except Py4JJavaError as taken:
        fs.delete(child(generation), True)
        raise RuntimeError(f"another writer has saved generation {number + 1} of {path}") from taken
    pointer.writeBytes(generation)
    pointer.close()
    kept = {generation, before.rsplit("/", 1)[1] if before else None}
    for name in names:
        stale = name.startswith("gen") and name not in kept and int(name[3:13]) <= number
        if stale or (name.startswith(_POINTER) and int(name.removeprefix(_POINTER)) < number):
            fs.delete(child(name), True)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the current generation, and of that alone; empty before the first save."""
    _, generation = _current(spark, path)
    return spark.createDataFrame([], schema) if generation is None else spark.read.schema(schema).json(generation)


def latest_state(snapshots: DataFrame, key: str = "book", at: str = "updated_ms") -> DataFrame:
    picked = snapshots.groupBy(key).agg(F.max_by(F.struct(*snapshots.columns), at).alias("_s"))
    return picked.select("_s.*")


def last_alert(alerts: DataFrame, kind: str, book: str = "book") -> DataFrame:
    hit = alerts.filter(F.col("kind") == kind)
    return hit.groupBy(book).agg(F.max_by(F.struct(*alerts.columns), "ms").alias("_a")).select("_a.*")


def latest_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """Newest ``n`` rows (a report's feature; planned as a distributed top-n)."""
    return df.orderBy(F.desc_nulls_last(order)).limit(n)


def log_experiment(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to dotted columns, any depth."""
    def walk(schema: T.StructType, prefix: str = ""):
        for field in schema.fields:
            name = f"{prefix}{field.name}"
            if isinstance(field.dataType, T.StructType):
                yield from walk(field.dataType, f"{name}.")
            else:
                yield name
    return df.select(*[F.col(n).alias(n.replace(".", "_")) for n in walk(df.schema)])


def write_report(table: DataFrame, root: str, prefix: str, stamp: str, fmt: str = "csv") -> str:
    """Result table with its run stamp in the folder name and as a column."""
    path = f"{root.rstrip('/')}/{prefix}_{stamp}"
    stamped = table.withColumn("stamp", F.lit(stamp))
    writer = stamped.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path))
    return path


def newest_report(paths: DataFrame, prefix: str) -> DataFrame:
    """Newest (path, stamp) among report paths named ``prefix_YYYYMMDD_HHMMSS``."""
    text = F.regexp_extract("path", rf"{prefix}_(\d{{8}}_\d{{6}})", 1)
    stamped = paths.withColumn("stamp", F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyyMMdd_HHmmss"))).filter(F.col("stamp").isNotNull())
    return stamped.agg(F.max_by("path", "stamp").alias("path"), F.max("stamp").alias("stamp"))
