"""A corpus pipeline: quality rules, near duplicates, repeated passages, secrets, packing.

Each stage works on all rows its predecessor kept. ``run`` writes every stage's rows as Parquet below the shared
checkpoint folder and reads them back for the next. Documents have the columns ``COLUMNS``; further ones are left out.

What a stage writes on its way is deleted when the next one of the same thread begins on documents that have been
written and reread; ``run`` deletes all but the result.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import folders, remove, table, written
from tickloom.llm.near_duplicates import jaccard_join
from tickloom.llm.packing import pack_documents
from tickloom.llm.quality_rules import quality_rules
from tickloom.llm.secret_scan import redact
from tickloom.llm.sentence_spans import dedup_spans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_ROWS_BITS = 40  # a file has fewer than 2**40 rows


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


_left = threading.local()


def _stage(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that deletes what earlier ones have left, unless its documents still come from there, and remembers its own."""
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = getattr(_left, "paths", [])
        names = {path.rsplit("/", 1)[1] for path in held}
        if held and not any(names & set(file.split("/")) for file in docs.inputFiles()):
            remove(spark, held)
        with folders(spark) as own:
            result = step(spark, docs, sf_dir)
        _left.paths = held + own
        return result

    return run_step


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a ``row`` number each, its file's number and its place there; ids may be null or shared.

    Numbers follow from the files, so both readings of a table give the same. What is no Parquet table is written as one.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs = written(_documents(docs))
    names = docs.select(F.col("_metadata.file_path").alias("file")).distinct()
    files = written(names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("number")))
    placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    # One row per file, known from the table's file list.
    return placed.join(F.broadcast(files), "file").select(*COLUMNS, (F.shiftleft("number", _ROWS_BITS) + F.col("at")).alias("row"))


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each by its own verdict, also where a doc_id is null or shared."""
    return quality_rules(docs, carried=COLUMNS).filter("kept").select("carried.*")


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest doc_id, null ids last; of equal ids the one with the
    smallest hash of the text. Different texts are different documents whatever their ids. Rows without a word are in no
    class; of these only repeats of both id and text go."""
    keyed = _keyed(docs)
    classes = jaccard_join(keyed.withColumn("doc_id", F.col("row"))).select(F.col("doc_id").alias("row"), "class_id")
    blank = F.coalesce(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))
    own = keyed.select("row", "doc_id", blank.alias("blank"), F.when(blank, F.col("text")).alias("blank_text"), F.xxhash64("text").alias("version"))
    group = [F.when(~F.col("blank"), F.col("class_id")).alias("class"), F.when(F.col("blank"), F.col("doc_id")).alias("blank_id"), "blank", "blank_text"]
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "version", "row")
    kept = written(own.join(classes, "row").groupBy(*group).agg(F.min(place).alias("first")).select(F.col("first.row").alias("row")))
    return _documents(keyed.join(kept, "row", "left_semi"))


@_stage
def new_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated spans; a document stays even if nothing of its text does."""
    return _documents(dedup_spans(docs)).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every reported secret replaced by a mark."""
    return _documents(redact(docs)).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", new_passages),
    ("secret scans", no_secrets),
    ("best-fit packing", packed),
]

# Signature hashes, redaction and tokenizer ids are outside SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        with folders(spark) as own:
            docs = written(result)
        remove(spark, before)
        before = own
    remove(spark, _left.paths)
    return docs
