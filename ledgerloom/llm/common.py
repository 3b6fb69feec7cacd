"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the rules: blank and the five control white spaces.
BLANKS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent (tests on one machine) a temporary folder is made."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add; input columns of these names give way."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column, separators: str = BLANKS) -> Column:
    """Non-empty words between ``separators``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, bound to the variable of a one-element ``transform``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a task derives at once stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less most rows whose ``doc_id`` is not in ``ids``: a bitmap of id hashes, at most 64 MiB.

    Rows that stay by chance are dropped by the join that follows; the bitmap only spares shuffling texts."""
    bits = 1 << min(29, max(15, (8 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("map")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in rows:
        own = np.frombuffer(bytes(row["map"]), np.uint8)
        bitmap[row["part"] * 4096 : row["part"] * 4096 + len(own)] = own
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def known(places):
        p = places.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 3] >> (p & 7)) & 1 == 1)

    return docs.where(known(at))
