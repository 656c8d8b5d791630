"""Labelled samples of documents, held-out folds, and the result columns of a scoring query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1 << 20


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds).cast("long"))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """``doc_id, text, label`` of about ``most`` labelled rows outside the held-out fold, chosen by a hash of the id.

    Only this bounded set of ids is broadcast. Null labels and ids are left out; a doc_id that is labelled twice has its
    larger label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        "doc_id is not null and label is not null").filter(fold("doc_id", folds) != held)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_GRAIN)) < int(share * _GRAIN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def verdict(scored: DataFrame, folds: int, held: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` from ``doc_id`` and ``score``."""
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
