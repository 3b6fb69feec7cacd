"""Annotation corpora in one schema, file inventories by byte ranges, tables refreshed by changed source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import groups
from ..functions.storage import written
from ..operators.operations import changed_slices, table_fingerprint
from .imports import read_box_corpus, read_nested_corpus

#: Bytes of a digested range, and digests that one node of the digest tree joins.
RANGE_BYTES, FAN = 1 << 20, 1024


# --- corpora -----------------------------------------------------------------------------


def split_of(path: Column) -> Column:
    """Split by the folder names of a path."""
    named = lambda *names: path.rlike("(?i)/(" + "|".join(names) + ")/")
    return F.when(named("train", "training"), "train").when(named("validation", "valid", "val", "dev"), "validation").when(named("test", "testing"), "test").otherwise("unknown")


def _rows(lines: DataFrame, source: str) -> DataFrame:
    """Lines of either layout in the common schema, the file's key beside them."""
    category = F.col("category") if "category" in lines.columns else F.lit(None).cast("string")
    kind = F.when(split_of(F.col("file")) == "train", "train").otherwise("validation")
    return lines.select(
        "key", F.concat_ws(":", F.lit(source), "key", F.lit("line"), F.col("line_no").cast("string")).alias("row_id"), F.lit(source).alias("source"),
        F.lit("line").alias("level"), kind.alias("split"), "line_no", "text", "box",
        F.when(category.isNotNull(), F.create_map(F.lit("category"), category)).otherwise(F.create_map().cast("map<string,string>")).alias("fields"))


def _documents(rows: DataFrame, source: str, fields: DataFrame | None) -> DataFrame:
    """One row per file: its lines in order, the fields of its sibling file, benchmark use only."""
    # A file's text is one value, so its lines meet in one row; they are ordered there.
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    whole = rows.groupBy("key").agg(text.alias("text"))
    found = whole.join(fields, "key", "left") if fields is not None else whole.withColumn("fields", F.lit(None).cast("map<string,string>"))
    return found.select(
        "key", F.concat_ws(":", F.lit(source), "key", F.lit("document")).alias("row_id"), F.lit(source).alias("source"), F.lit("document").alias("level"),
        F.lit("benchmark").alias("split"), F.lit(None).cast("int").alias("line_no"), "text", F.lit(None).cast("array<int>").alias("box"),
        F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"))


def entity_fields(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Fields of sibling entity files: one flat JSON object each; a file that does not parse has none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_path"), key, 1).alias("key"), "value")
    parsed = files.select("key", F.from_json("value", "map<string,string>").alias("fields")).where(F.col("fields").isNotNull() & (F.col("key") != ""))
    return parsed.groupBy("key").agg(F.max_by("fields", F.to_json("fields")).alias("fields"))


def annotation_corpora_union(nested: DataFrame | None, boxed: DataFrame | None, entities: DataFrame | None = None, names: tuple[str, str] = ("nested", "boxed")) -> DataFrame:
    """Line rows and one document row a file of both layouts in one schema.

    ``nested`` and ``boxed`` are line rows with ``file``, ``key`` (what a file and its siblings share) and
    ``line_no``; ``entities`` are fields by key for the boxed layout. Files pair up by key in a join. A file
    whose lines all fell away has no document row; a text with the replacement character is no label."""
    parts = []
    for lines, source, fields in ((nested, names[0], None), (boxed, names[1], entities)):
        if lines is not None:
            rows = _rows(lines.where((F.trim("text") != "") & ~F.contains("text", F.lit("�"))), source)
            parts += [rows, _documents(rows, source, fields)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumns({"usable_for_training": F.col("level") == "line", "usable_for_benchmark": F.lit(True), "document_type": F.lit("receipt")})


def keyed(lines: DataFrame, key: str) -> DataFrame:
    """Line rows of a reader plus ``key``, what ``key`` takes from their path."""
    return lines.withColumn("key", F.regexp_extract("file", key, 1)).where(F.col("key") != "")


def read_corpora(spark: SparkSession, nested_path: str, box_path: str, entity_path: str, key: str = r"/([^/]+)\.[a-z]+$") -> DataFrame:
    """Both corpora from their folders; sibling files share what ``key`` takes from their paths."""
    nested, boxed = keyed(read_nested_corpus(spark, nested_path), key), keyed(read_box_corpus(spark, box_path), key)
    return annotation_corpora_union(nested, boxed, entity_fields(spark, entity_path, key))


# --- file inventory ----------------------------------------------------------------------


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``length`` and ``modified`` of all files with a byte below ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def metadata_fingerprint(files: DataFrame, root: str, *keys: Column) -> DataFrame:
    """Order-free digest of names, lengths and times per ``keys``: tells a changed folder without reading it."""
    relative = F.regexp_replace("file", "^.*" + root.rstrip("/") + "/", "")
    entry = F.xxhash64(relative, "length", F.col("modified").cast("double"))
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.bit_xor(entry).alias("hash_xor"), F.sum(entry.cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def combined(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``digest`` of each ``keys``: a tree over ``nodes`` (keys, ``at``, ``digest``), ``FAN`` neighbours a node.

    A node is the digest of its children's digests in order, so no row ever holds more than ``FAN`` of them. A
    tree is as high as its own largest ``at`` asks for, one level at least, whatever trees stand beside it."""
    tops = nodes.groupBy(*keys).agg(F.max("at").alias("top"))
    largest, height = tops.agg(F.max("top")).first()[0] or 0, 1
    while FAN**height <= largest:
        height += 1
    left = sum(((F.col("top") >= FAN**k).cast("int") for k in range(1, height)), F.lit(1))
    nodes = groups.join_null_safe(nodes, tops.withColumn("left", left).drop("top"), keys, "inner")
    for _ in range(height):
        children = F.sort_array(F.collect_list(F.struct("at", "digest")))
        joined = F.sha2(F.array_join(F.transform(children, lambda x: x["digest"]), ""), 256)
        nodes = nodes.groupBy(*keys, F.floor(F.col("at") / FAN).alias("at")).agg(
            F.when(F.max("left") > 0, joined).otherwise(F.max("digest")).alias("digest"), (F.max("left") - 1).alias("left"))
    return nodes.select(*keys, "digest")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``bytes`` read, ``lines`` and ``digest`` of all files below ``path``, of any length.

    Spark reads byte ranges of a file in many tasks and cuts them at line ends, so a row is one line of raw
    bytes. A line's offset is its place in its range plus the bytes of the ranges before, whatever the ranges
    are; lines are joined by fixed stretches of ``RANGE_BYTES`` and those by the digest tree. Contents become
    digests in the scan; only digests are shuffled."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
        (F.octet_length("value") + 1).cast("long").alias("size"), F.sha2(F.col("value").cast("binary"), 256).alias("sha"))
    until = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    inside = lines.withColumn("inside", F.sum("size").over(until("file", "block").orderBy("id")) - F.col("size"))
    blocks = lines.groupBy("file", "block").agg(F.sum("size").alias("moved"))
    starts = blocks.select("file", "block", (F.sum("moved").over(until("file").orderBy("block")) - F.col("moved")).alias("start"))
    placed = inside.join(starts, ["file", "block"]).withColumn("offset", F.col("start") + F.col("inside"))
    entry = F.struct("offset", "sha")
    ranges = placed.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).alias("at")).agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.concat(x["offset"].cast("string"), F.lit(":"), x["sha"])), ","), 256).alias("digest"))
    sizes = lines.groupBy("file").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("lines"))
    return sizes.join(combined(ranges, ["file"]), "file")


def file_inventory(spark: SparkSession, path: str, dataset: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """Files, bytes, lines, split mix and content digest of every dataset below ``path``.

    ``dataset`` takes a dataset's name from a file's path. The digest covers lengths and contents of its files in
    the order of their own digests. Files without a byte are not counted, as Spark's readers skip them."""
    names = file_names(spark, path).select(F.regexp_replace("file", "^file:/+", "/").alias("file"), "length")
    digests = file_digests(spark, path).withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    files = names.join(digests.select("file", "lines", "digest"), "file", "left").select(
        F.regexp_extract("file", dataset, 1).alias("dataset"), split_of(F.col("file")).alias("split"), "length", F.coalesce("lines", F.lit(0)).alias("lines"),
        F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.coalesce("digest", F.lit(""))), 256).alias("digest"))
    ranked = groups.positions(files, ["dataset"], [F.asc("digest")], "at").withColumn("at", F.col("at") - 1)
    mix = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test", "unknown")]
    sums = ranked.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum("lines").alias("lines"), *mix)
    return sums.join(combined(ranked.select("dataset", "at", "digest"), ["dataset"]), "dataset")


# --- refreshed tables --------------------------------------------------------------------


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def refresh_sources(current: DataFrame, path: str, run: int, columns: list[str], build: Callable[[DataFrame], DataFrame] | None = None, key: str = "source") -> DataFrame:
    """Bring the table at ``path`` up to date with ``current`` and return the sources that were rewritten.

    A source is rewritten when its fingerprint over ``columns`` is new or another one than that of the run
    before; all other partitions stay as they are. Rows come first and fingerprints after them, under the
    number of the run, so a run that broke off is simply repeated. A source that is gone keeps its files but
    not its fingerprint: ``refreshed`` leaves it out."""
    spark = current.sparkSession
    now = table_fingerprint(current, [key], columns)
    prints = _stored(spark, f"{path}/fingerprints")
    earlier = prints.where(F.col("run") < run) if prints is not None else None
    last = earlier.agg(F.max("run")).first()[0] if earlier is not None else None
    before = earlier.where(F.col("run") == last).drop("run") if last is not None else now.limit(0)
    fingerprints = written(now, "fingerprints")
    changed = written(changed_slices(fingerprints, before, [key]), "changed")
    rows = current.join(changed, key, "left_semi")
    ready = (build(rows) if build else rows).withColumn("written_by", F.lit(run))
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/rows")
    fingerprints.write.mode("overwrite").parquet(f"{path}/fingerprints/run={run}")
    return changed


def refreshed(spark: SparkSession, path: str, key: str = "source") -> DataFrame:
    """The rows of all sources that the last run knew."""
    prints = spark.read.parquet(f"{path}/fingerprints")
    last = prints.agg(F.max("run")).first()[0]
    alive = prints.where(F.col("run") == last).select(F.col(key).cast("string").alias(key))
    return spark.read.parquet(f"{path}/rows").withColumn(key, F.col(key).cast("string")).join(alive, key, "left_semi")
