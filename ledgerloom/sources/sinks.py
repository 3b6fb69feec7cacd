"""Writers: safe CSV, JSON lines, export manifest, keyed merge, manifests by split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.money import EXACT
from ..functions.text import csv_cell


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as the exported text of its cells."""
    return df.select(*[csv_cell(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.csv(path, header=True, lineSep="\r\n", escape='"', emptyValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    """``df`` has one ``value`` column with one JSON object per row."""
    df.select("value").write.text(path)


def manifest_row(df: DataFrame, report_type: str, path: str, month: str | None = None) -> DataFrame:
    """Row count and order-free checksum of an export, one row."""
    row = F.xxhash64(*df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("hash_xor"), F.sum(row.cast(EXACT)).cast("string").alias("hash_sum")
    ).select(F.lit(report_type).alias("type"), F.lit(path).alias("object_key"), F.lit(month).alias("month"), "*")


def export(df: DataFrame, report_type: str, path: str, manifest_path: str, month: str | None = None) -> None:
    """Write a report, then append the manifest row of what was written: its rows and
    checksums read back from the files, their bytes and a digest over the part digests."""
    write_csv(df, path)
    spark = df.sparkSession
    written = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=", ".join(f"`{c}` string" for c in df.columns))
    parts = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("sha"))
    # One digest per part file.
    whole = parts.agg(F.sum("length").alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list("sha")), ""), 256).alias("sha256"))
    manifest_row(written, report_type, path, month).join(whole).write.mode("append").parquet(manifest_path)


def merge_upsert(current: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Table after a keyed merge: updated rows replace, new rows join, others stay.

    Null keys match null keys. Of several updates of one key the last by the ``order`` columns of ``updates`` counts,
    of equally late ones the largest by its JSON form (maps have no order of their own), so none multiplies rows."""
    values = [c for c in current.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*(order or []), F.to_json(F.struct(*values)))).alias("__new") if values else None
    one = updates.groupBy(*keys).agg(last) if values else updates.select(*keys).distinct().withColumn("__new", F.struct())
    u = one.select(*[F.col(k).alias(f"__{k}") for k in keys], "__new", F.lit(True).alias("__hit"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = current.join(u, same, "full_outer")
    hit = F.col("__hit").isNotNull()
    return joined.select(*[F.when(hit, F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys], *[F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in values])


# The training manifests.
MANIFESTS = (
    "character_train", "character_validation", "line_train", "line_validation", "document_benchmark", "project_fixture_benchmark",
    "hardcase_train", "hardcase_validation",
)


def with_manifest_key(rows: DataFrame) -> DataFrame:
    """Names the manifest a curated row belongs to.

    ``level`` is character, line, document, fixture or hardcase; whatever is not for training is for validation,
    documents and fixtures are for the benchmark. A row of another level has no manifest."""
    side = F.when(F.col("split") == "train", "train").otherwise("validation")
    named = (
        F.when(F.col("level") == "document", "document_benchmark").when(F.col("level") == "fixture", "project_fixture_benchmark")
        .when(F.col("level").isin("character", "line", "hardcase"), F.concat_ws("_", F.col("level"), side))
    )
    return rows.withColumn("manifest", named)


def write_manifests(rows: DataFrame, path: str) -> None:
    """All manifests as JSON lines, a folder each; rows without a manifest are not written."""
    with_manifest_key(rows).where(F.col("manifest").isNotNull()).write.partitionBy("manifest").mode("overwrite").json(path)


def read_manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all manifests with their ``manifest``."""
    return spark.read.schema(f"{schema}, manifest string").json(path)


def manifest_sizes(rows: DataFrame) -> DataFrame:
    """Rows of each of the eight manifests, empty ones too."""
    names = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in MANIFESTS])).alias("manifest"))
    counted = rows.groupBy("manifest").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("letters"), F.count_distinct("source").alias("sources"))
    return names.join(counted, "manifest", "left").select("manifest", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "letters", "sources")])
