"""Readers: ledger CSV imports, JSON lines, numbered lines, annotation corpora."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.money import CURRENCIES, parse_import_amount
from ..functions.text import parse_flag


IMPORT_COLUMNS = (
    "title", "occurred_at", "date", "currency", "amount_minor", "amount", "tax_minor", "tax", "reimbursable", "business_expense",
    "merchant", "merchant_name", "description",
)


def import_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files below ``path`` by their header line; only names and headers reach the driver."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "id")).alias("header")).orderBy("file")
    found: dict[str, list[str]] = {}
    for row in first.toLocalIterator():
        found.setdefault(row["header"], []).append(row["file"])
    return found


def read_import_csv(spark: SparkSession, path: str) -> DataFrame:
    """The import columns as text, one batch per file, whatever the order and case of its columns.

    Files with the same header are read together by Spark's CSV reader, a file a task as a quoted cell may hold
    line ends. Rows are numbered from 0 by their place in the file, blank lines left out. ``parse_failed`` marks rows
    with more or fewer cells than the header. Of two columns of one name the last counts."""
    parts = []
    for header, files in import_headers(spark, path).items():
        names = [name.strip().lower() for name in next(csv.reader([header.removeprefix("\ufeff")]), [])]
        cells = [f"c{k}" for k in range(len(names))]
        place = dict(zip(names, cells))
        raw = spark.read.csv(
            files, schema=", ".join(f"{c} string" for c in [*cells, "_broken"]), header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
        columns = [(F.col(place[n]) if n in place else F.lit(None).cast("string")).alias(n) for n in IMPORT_COLUMNS]
        parts.append(raw.select(F.col("_metadata.file_path").alias("batch_id"), F.monotonically_increasing_id().alias("id"), *columns, F.col("_broken").isNotNull().alias("parse_failed")))
    if not parts:
        columns = ", ".join(f"{name} string" for name in IMPORT_COLUMNS)
        return spark.createDataFrame([], f"batch_id string, row_no long, {columns}, parse_failed boolean")
    rows = reduce(DataFrame.unionByName, parts)
    # a file's rows are neighbours in one task
    starts = rows.groupBy("batch_id").agg(F.min("id").alias("first"))
    return rows.join(starts, "batch_id").select("batch_id", (F.col("id") - F.col("first")).alias("row_no"), *IMPORT_COLUMNS, "parse_failed")


def _field(df: DataFrame, *names: str) -> Column:
    found = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def validate_import(raw: DataFrame) -> DataFrame:
    """Typed columns and the ``errors`` (field, code) of every row."""
    col = lambda *n: _field(raw, *n)
    has = lambda n: (F.coalesce(F.trim(F.col(n)), F.lit("")) != "") if n in raw.columns else F.lit(False)
    when = col("occurred_at", "date").try_cast("timestamp_ntz")
    amount = parse_import_amount(col("amount_minor", "amount"), has("amount_minor"))
    tax_text = col("tax_minor", "tax")
    tax = F.when(tax_text.isNull(), F.lit(0).cast("decimal(38,0)")).otherwise(parse_import_amount(tax_text, has("tax_minor")))
    typed = raw.select(
        "batch_id", "row_no", col("title").alias("title"), when.alias("occurred_at"),
        F.coalesce(col("currency"), F.lit("TRY")).alias("currency"), amount.alias("amount_minor"), tax.alias("tax_minor"),
        F.coalesce(F.col("parse_failed"), F.lit(False)).alias("parse_failed") if "parse_failed" in raw.columns else F.lit(False).alias("parse_failed"),
        parse_flag(col("reimbursable")).alias("reimbursable"), parse_flag(col("business_expense")).alias("business_expense"),
        col("merchant", "merchant_name").alias("merchant_name"), col("description").alias("description"),
    )
    checks = (
        ("row", "CSV_PARSE_FAILED", F.col("parse_failed")),
        ("title", "TITLE_REQUIRED", F.col("title").isNull()), ("occurred_at", "VALID_DATE_REQUIRED", F.col("occurred_at").isNull()),
        ("currency", "INVALID_CURRENCY", ~F.col("currency").isin(*CURRENCIES)),
        ("amount", "VALID_AMOUNT_REQUIRED", F.col("amount_minor").isNull()),
        ("tax", "INVALID_TAX_AMOUNT", F.col("tax_minor").isNull()),
        ("reimbursable", "INVALID_BOOLEAN", F.col("reimbursable").isNull()),
        ("business_expense", "INVALID_BOOLEAN", F.col("business_expense").isNull()),
    )
    errors = F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(c).alias("code"))) for f, c, bad in checks])
    return typed.withColumn("errors", F.filter(errors, lambda e: e.isNotNull())).drop("parse_failed")


def import_errors(validated: DataFrame) -> DataFrame:
    """One row per bad field; numbered as in the file, after the header."""
    rows = validated.select("batch_id", (F.col("row_no") + 2).alias("row"), F.explode_outer("errors").alias("e"))
    return rows.where(F.col("e").isNotNull()).select("batch_id", "row", "e.field", "e.code")


def import_batches(validated: DataFrame) -> DataFrame:
    """All-or-nothing outcome of each batch with its statistics."""
    failed = F.sum(F.size("errors"))
    return validated.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_rows"), failed.alias("failed_rows"),
        F.when(failed > 0, 0).otherwise(F.count(F.lit(1))).alias("imported_rows"),
        F.when(failed > 0, "FAILED").otherwise("SUCCEEDED").alias("status"),
    )


def accepted_rows(validated: DataFrame) -> DataFrame:
    """Rows of batches without any error."""
    bad = import_batches(validated).where(F.col("status") == "FAILED").select("batch_id")
    return validated.join(bad, "batch_id", "left_anti").drop("errors")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse as objects of the schema, and the quarantined lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_json_rows(lines, schema)


def parse_json_rows(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    parsed = lines.withColumn(
        "r", F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    rest = [c for c in lines.columns if c != "value"]
    good = parsed.where(~bad).select(*rest, "r.*").drop("_corrupt_record")
    return good, parsed.where(bad).select(*rest, "value")


def _corners(points: Column, padding: int) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    left, top = F.greatest(F.lit(0), F.array_min(xs) - padding), F.greatest(F.lit(0), F.array_min(ys) - padding)
    return F.array(left, top, F.greatest(left + 1, F.array_max(xs) + padding), F.greatest(top + 1, F.array_max(ys) + padding))


LINE_SCHEMA = (
    "valid_line array<struct<category:string,words:array<struct<text:string,quad:struct<x1:double,y1:double,x2:double,y2:double,"
    "x3:double,y3:double,x4:double,y4:double>>>>>"
)


def read_nested_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Line rows of a corpus with one JSON object per file: lines of word quads."""
    files = spark.read.schema(LINE_SCHEMA).json(path, multiLine=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode("valid_line").alias("line_no", "line"))
    words = F.filter(F.transform("line.words", lambda w: F.trim(w["text"])), lambda w: w != "")
    points = F.flatten(F.transform("line.words", lambda w: F.array(*[
        F.struct(w["quad"][f"x{i}"].cast("int").alias("x"), w["quad"][f"y{i}"].cast("int").alias("y")) for i in range(1, 5)])))
    return lines.select("file", "line_no", F.array_join(words, " ").alias("text"), _corners(points, 4).alias("box"),
                        F.col("line.category").alias("category")).where(F.col("text") != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no`` (from 0) and ``value`` of all text files below ``path``, large files in many tasks.

    A line's number is its place in the byte range that Spark read plus the lines of the ranges before."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    inside = raw.withColumn("inside", F.row_number().over(W.partitionBy("file", "block").orderBy("id")) - 1)
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    joined = inside.join(sizes.select("file", "block", before.alias("start")), ["file", "block"])
    return joined.select("file", (F.col("start") + F.col("inside")).cast("int").alias("line_no"), "value")


def read_box_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Line rows of a corpus of text files: eight corner numbers, then the text."""
    parts = numbered_lines(spark, path).withColumn("p", F.split("value", ",", 9)).where(F.size("p") == 9)
    number = lambda i: F.trim(F.get("p", F.lit(i))).try_cast("int")
    points = F.array(*[F.struct(number(2 * i).alias("x"), number(2 * i + 1).alias("y")) for i in range(4)])
    rows = parts.select("file", "line_no", F.trim(F.get("p", F.lit(8))).alias("text"), _corners(points, 3).alias("box"),
                        F.exists(points, lambda q: q["x"].isNull() | q["y"].isNull()).alias("bad"))
    return rows.where(~F.col("bad") & (F.col("text") != "")).drop("bad")
