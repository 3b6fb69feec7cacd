"""Registered queries of the pipeline operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, conversation_repair, decontaminate, html_text, jaccard_join, language_id, line_dedup, merkle, oracles, quality_model, quality_rules, token_counts, token_store, toxicity
from ledgerloom.llm.common import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decode(bpe.encode(docs, path), path))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.quality_rules(docs, keep_text=False).select(*columns)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of every document in the token files."""
    return token_store.stored_layout(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    text = html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document."""
    docs, benchmark = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.report(decontaminate.decontaminate(docs, benchmark))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a digest of the rest of every document."""
    return line_dedup.report(line_dedup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model of the labelled ones."""
    return quality_model.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.languages(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every document."""
    return merkle.verified(read_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a model of the labelled ones."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least edits and a digest of the repaired rows of every damaged conversation."""
    return conversation_repair.repaired(read_table(spark, sf_dir, "conversations"))


QUERIES = (
    op1_token_counts, op2_bpe_round_trip, op3_quality_rules, op4_token_store, op5_html_text,
    op6_decontaminate, op7_line_dedup, op8_quality_classifier, op9_jaccard_join, op10_language_id,
    op11_merkle_manifest, op12_toxicity, op13_conversation_repair,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


#: SQL for the operators that it can express; the others are tested against brute force.
ORACLE_SQL = {"op3_quality_rules": oracles.OP3, "op6_decontaminate": oracles.OP6, "op9_jaccard_join": oracles.OP9, "op11_merkle_manifest": oracles.OP11, "op13_conversation_repair": oracles.OP13}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
