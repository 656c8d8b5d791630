"""Registered queries of the text operators, with production settings over whole tables, and their SQL where it can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import chat_format, cross_polytope, merkle_manifest, naive_bayes_support, near_duplicates, oracles, packing, prefix_trie, quality_rules, secret_scan, sentence_spans, suffix_pieces, toxicity_trees, warc
from tickloom.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("distance")


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_join(table(spark, sf_dir, "documents"))


def learned_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_bayes_support.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_trees.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = suffix_pieces.encode_documents(table(spark, sf_dir, "documents"), PIECES)
    decoded = suffix_pieces.decode_ids("ids", PIECES)
    return encoded.select("doc_id", "n_ids", "ids_crc32", decoded.eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(table(spark, sf_dir, "embeddings"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_spans(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", "removed")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_digests(chat_format.with_marked(table(spark, sf_dir, "conversations")))


def trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("first_rank", "last_rank")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"), merkle_manifest.without_line_feeds()).drop("proof")


QUERIES = {
    "op1_warc_segments": archives,
    "op2_mcd_quality": quality,
    "op3_nb_support": learned_quality,
    "op4_jaccard_forest": jaccard,
    "op5_certified_packing": packed,
    "op6_boosted_toxicity": toxicity,
    "op7_suffix_pieces": pieces,
    "op8_sentence_spans": spans,
    "op9_cross_polytope": vectors,
    "op10_secret_structure": secrets,
    "op11_schema_chat": chats,
    "op12_interval_trie": trie,
    "op13_octopus_manifest": manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op1_warc_segments": oracles.archives(),
    "op2_mcd_quality": oracles.quality(),
    "op4_jaccard_forest": oracles.jaccard(),
    "op9_cross_polytope": oracles.vectors(),
    "op11_schema_chat": oracles.chats(),
    "op12_interval_trie": oracles.trie(),
    "op13_octopus_manifest": oracles.manifest(),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
