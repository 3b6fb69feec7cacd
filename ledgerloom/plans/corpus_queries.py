"""Corpora, inventories and refreshed tables over files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import scratch
from ..sources import corpora, imports
from .bindings import with_bindings
from .registry import query
from .stream_queries import VALID

# Documents in files: one folder a source and eighth of the ids, in the order of the ids.
FILED = """filed AS (SELECT 'part-' || source || '-' || doc_id % 8 AS dataset, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source, doc_id % 8 ORDER BY doc_id) AS k FROM documents),
  cut AS (SELECT dataset, k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM filed),
  placed AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY dataset ORDER BY k, j) - strlen(line) - 1 AS off FROM cut),
  stretch AS (SELECT dataset, off // 1048576 AS r, sha256(string_agg(CAST(off AS VARCHAR) || ':' || sha256(line), ',' ORDER BY off)) AS digest FROM placed GROUP BY 1, 2),
  whole AS (SELECT dataset, sha256(string_agg(digest, '' ORDER BY r)) AS digest FROM stretch GROUP BY dataset)"""


@query("file_inventory", with_bindings(
    """SELECT dataset, 1::BIGINT AS files, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, count(*) AS lines, 0::BIGINT AS train, 0::BIGINT AS validation, 0::BIGINT AS test, 1::BIGINT AS unknown,
      sha256(sha256(CAST(sum(strlen(line) + 1) AS VARCHAR) || ':' || any_value(w.digest))) AS digest FROM cut JOIN whole w USING (dataset) GROUP BY dataset""", *FILED.split(",\n  ")))
def _(t):
    path = scratch(t.spark, "filed")
    folder = F.concat(F.lit("part-"), "source", F.lit("-"), (F.col("doc_id") % 8).cast("string")).alias("folder")
    rows = t.documents.select(folder, F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    # an eighth of a source is one file, as a file is written by one task
    ready = rows.repartition("folder").sortWithinPartitions("folder", "doc_id").select("folder", "text")
    ready.write.option("maxRecordsPerFile", 0).partitionBy("folder").text(path)
    return corpora.file_inventory(t.spark, path, r"/folder=([^/]+)/[^/]+$")


@query("incremental_sources", with_bindings(
    """SELECT source, CASE WHEN bool_or(doc_id % 97 = 5) THEN 2 ELSE 1 END AS written_by, count(*) AS rows, CAST(sum(length(text) + CASE WHEN doc_id % 97 = 5 THEN 1 ELSE 0 END) AS BIGINT) AS letters
    FROM documents WHERE source <> (SELECT max(source) FROM documents) GROUP BY source"""))
def _(t):
    """Two runs over a table: between them some texts change and the last source goes."""
    path = scratch(t.spark, "refreshed")
    docs = t.documents.select("doc_id", "source", "text")
    gone = docs.agg(F.max("source").alias("gone"))
    later = docs.withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).join(gone, F.col("source") == F.col("gone"), "left_anti")
    corpora.refresh_sources(docs, path, 1, ["doc_id", "text"])
    corpora.refresh_sources(later, path, 2, ["doc_id", "text"])
    return corpora.refreshed(t.spark, path).groupBy("source", "written_by").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("letters"))


CORPUS = (
    "picked AS (SELECT n_nationkey AS k, 'file-' || n_nationkey AS key, n_name FROM nation)",
    "suppliers AS (SELECT s_nationkey AS k, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier)",
    """boxed AS (SELECT p.key, CAST(i AS INTEGER) AS line_no, s_name || ', ' || CASE WHEN s_suppkey % 2 = 0 THEN 'TOTAL' ELSE 'TAX' END AS text,
      [greatest(0, s_suppkey % 40 - 3), greatest(0, s_suppkey % 30 - 3), s_suppkey % 40 + 23, s_suppkey % 30 + 13] AS box FROM suppliers JOIN picked p USING (k) WHERE s_suppkey % 9 <> 4)""",
)


@query("annotation_corpora_union", with_bindings(
    """SELECT key, 'boxed:' || key || ':line:' || line_no AS row_id, 'boxed' AS source, 'line' AS level, 'validation' AS split, line_no, text, array_to_string(box, ',') AS box, '' AS fields FROM boxed
    UNION ALL SELECT key, 'boxed:' || key || ':document', 'boxed', 'document', 'benchmark', NULL, string_agg(text, chr(10) ORDER BY line_no), NULL,
      CASE WHEN any_value(k) % 5 <> 2 THEN 'company=' || any_value(n_name) ELSE '' END FROM boxed JOIN picked USING (key) GROUP BY key
    UNION ALL SELECT key, 'nested:' || key || ':line:0', 'nested', 'line', 'validation', 0, n_name || ' x' || k, '6,6,54,34', 'category=menu' FROM picked
    UNION ALL SELECT key, 'nested:' || key || ':document', 'nested', 'document', 'benchmark', NULL, n_name || ' x' || k, NULL, '' FROM picked""", *CORPUS))
def _(t):
    """Files of both layouts for every nation, the boxes from its suppliers; one entity file in five is broken."""
    path, key = scratch(t.spark, "corpora"), r"/key=([^/]+)/"
    named = t.nation.select(F.concat(F.lit("file-"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").alias("k"), "n_name")
    quad = F.struct(*[F.lit(v).alias(f"{a}{i}") for i, (x, y) in enumerate(((10.0, 10.0), (50.0, 10.0), (50.0, 30.0), (10.0, 30.0)), 1) for a, v in (("x", x), ("y", y))])
    word = lambda c: F.struct(c.alias("text"), quad.alias("quad"))
    line = F.struct(F.lit("menu").alias("category"), F.array(word(F.concat("n_name", F.lit(" "))), word(F.concat(F.lit("x"), F.col("k").cast("string")))).alias("words"))
    named.select("key", F.to_json(F.struct(F.array(line).alias("valid_line"))).alias("value")).write.partitionBy("key").text(f"{path}/nested")
    entity = F.when(F.col("k") % 5 == 2, "{broken").otherwise(F.to_json(F.struct(F.col("n_name").alias("company"))))
    named.select("key", entity.alias("value")).write.partitionBy("key").text(f"{path}/entities")
    x, y, s = F.col("s_suppkey") % 40, F.col("s_suppkey") % 30, F.col("s_suppkey")
    corners = [x, y, x + 20, y, x + 20, y + 10, x, y + 10]
    label = F.concat("s_name", F.lit(", "), F.when(s % 2 == 0, "TOTAL").otherwise("TAX"))
    value = F.when(s % 9 == 4, F.lit("torn,line")).otherwise(F.concat_ws(",", *[c.cast("string") for c in corners], label))
    box = t.supplier.select(F.concat(F.lit("file-"), F.col("s_nationkey").cast("string")).alias("key"), value.alias("value"), "s_suppkey")
    box.repartition("key").sortWithinPartitions("key", "s_suppkey").select("key", "value").write.partitionBy("key").text(f"{path}/box")
    rows = corpora.read_corpora(t.spark, f"{path}/nested", f"{path}/box", f"{path}/entities", key)
    pairs = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("key", "row_id", "source", "level", "split", "line_no", "text", F.array_join("box", ",").alias("box"), pairs.alias("fields"))


@query("csv_import_files", with_bindings(
    """SELECT 'batch-' || t.batch_id % 40 AS batch, count(*) AS total_rows, CAST(coalesce(any_value(n), 0) AS BIGINT) AS failed_rows, CASE WHEN any_value(n) IS NULL THEN count(*) ELSE 0 END AS imported_rows,
      CASE WHEN any_value(n) IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, CAST(max(e.last) AS BIGINT) AS last_bad_row
    FROM typed t LEFT JOIN (SELECT b, count(*) AS n, max(r + 1) AS last FROM (SELECT batch_id % 40 AS b, k AS r FROM errs JOIN (SELECT batch_id AS q, row_no, row_number() OVER (PARTITION BY batch_id % 40 ORDER BY row_no) AS k FROM typed) p
      ON q = batch_id AND p.row_no + 2 = errs.row) GROUP BY b) e ON e.b = t.batch_id % 40 GROUP BY t.batch_id % 40""", VALID))
def _(t):
    """Uploads as files with two kinds of header, read back, validated and accepted or refused as a whole."""
    path = scratch(t.spark, "uploads")
    rows = t.import_raw.withColumn("batch", F.concat(F.lit("batch-"), (F.col("batch_id") % 40).cast("string")))
    kinds = (("title", "date", "currency", "amount_minor", "amount", "tax", "reimbursable", "business_expense"), ("amount", "reimbursable", "TITLE", "Currency", "DATE", "amount_minor", "business_expense", "tax"))
    for k, columns in enumerate(kinds):
        own = rows.where(F.col("batch_id") % 2 == k).repartition("batch").sortWithinPartitions("batch", "row_no")
        own.select("batch", *[F.col(c.lower()).alias(c) for c in columns]).write.partitionBy("batch").option("header", "true").csv(f"{path}/{k}")
    checked = imports.validate_import(imports.read_import_csv(t.spark, path)).withColumn("batch_id", F.regexp_extract("batch_id", "batch=([^/]+)/", 1))
    last = imports.import_errors(checked).groupBy("batch_id").agg(F.max("row").alias("last_bad_row"))
    return imports.import_batches(checked).join(last, "batch_id", "left").withColumnRenamed("batch_id", "batch")
