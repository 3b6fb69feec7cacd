"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, decontamination, byte-pair round trip.

Every stage takes all rows that the one before kept, in the columns of ``documents``, and its decisions take
effect. A row of ``documents`` needs no unique id, text or source; what an operator does with nulls, repeats
and empty tables its own docstring says."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from ledgerloom.llm.common import read_table, stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules, the soft rules and their host let through."""
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one of whose lines none is left goes, one that was empty before stays."""
    left = line_dedup.line_dedup(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n", " ")) == "")
    return left.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard_join.keep_first(docs).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    judged = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document that is left."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path))


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("BPE encoding and decoding", round_trip),
]

#: SQL cannot express the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; each stage but the last is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.split()[0].lower())
    return docs
