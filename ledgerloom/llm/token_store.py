"""Token ids in files: one zstandard dictionary for all, one frame for each document.

Layout of a store folder, all written by Spark's own committing writer:

``dictionary``  one row: ``dict_sha256``, ``dictionary`` (bytes), ``width`` (bytes an id), ``end_id``
``chunks``      rows of at most about ``CHUNK`` bytes: ``shard``, ``first_id``, ``last_id``, ``dict_sha256``,
                ``shard_start`` (ids of the shard before the chunk), ``doc_ids``, ``n_tokens``, ``offsets``
                (of each frame in ``frames``) and ``frames``; documents ascend by ``doc_id``

A document is read by its chunk's id range and its own frame alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.bpe import worker_copy
from ledgerloom.llm.byte_chunks import ChunkTable
from ledgerloom.llm.common import file_bytes, shared_folder, slices
from ledgerloom.llm.pretokens import ByteSplitter

#: Bytes of frames in a chunk, at least one document.
CHUNK = 1 << 20
#: Chunks that a worker remembers while it writes.
CACHE = 700_000
#: Documents that train the dictionary (a bounded sample by a hash of the id) and the dictionary's bytes.
TRAIN_DOCS, DICT_BYTES = 1_000, 64 * 1024

CHUNK_SCHEMA = "shard int, first_id long, last_id long, dict_sha256 string, shard_start long, doc_ids array<long>, n_tokens array<int>, offsets array<int>, frames binary"


def id_width(definition: bytes) -> int:
    return 2 if Tokenizer.from_str(definition.decode("utf-8")).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def id_table(definition: bytes, width: int) -> ChunkTable:
    return ChunkTable(ByteSplitter(Tokenizer.from_str(definition.decode("utf-8"))), width, CACHE)


def train_dictionary(docs: DataFrame, definition: bytes, width: int, end_id: int) -> bytes:
    """Dictionary from about ``TRAIN_DOCS`` documents chosen by a hash of their id; empty where they are too few.

    The sample only shapes the compression: any dictionary gives the same ids back."""
    every = max(1, docs.count() // TRAIN_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").limit(4 * TRAIN_DOCS)
    texts = pa.array([r["text"] for r in sample.toLocalIterator()], pa.string())
    serialized = [ids + end_id.to_bytes(width, "little") for ids in id_table(definition, width).values(texts)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, serialized).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, level: int = 3) -> None:
    """Encode every whole text, append ``end_id`` and write the store to the new folder ``path``.

    Texts are dealt into ranges of ``doc_id`` before they are encoded, so encoding happens once. Null texts
    count as empty and get the end id alone; a null ``doc_id`` comes first; rows of one id follow each other
    by their text; an empty table gives a store without chunks. Other columns are not stored."""
    spark = docs.sparkSession
    definition = file_bytes(tokenizer_path)
    digest, width = hashlib.sha256(definition).hexdigest(), id_width(definition)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(rows, definition, width, end_id)
    dict_sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_sha, bytearray(dictionary), width, end_id)], "dict_sha256 string, dictionary binary, width int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast((definition, dictionary))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = worker_copy("store", digest, lambda: id_table(shared.value[0], width)), end_id.to_bytes(width, "little")
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        compressor = zstandard.ZstdCompressor(level=level, write_checksum=False, **options)
        shard, start, done, ids, counts, frames = TaskContext.get().partitionId(), 0, 0, [], [], []

        def chunk() -> pa.RecordBatch:
            sizes = np.cumsum([0, *map(len, frames)])
            known = [i for i in ids if i is not None]
            values = (shard, min(known, default=None), max(known, default=None), dict_sha, done, ids, counts, sizes[:-1].tolist(), b"".join(frames))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

        held = 0
        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), table.values(batch.column(1)), strict=True):
                serialized = encoded + end
                frame = compressor.compress(serialized)
                if frames and held + len(frame) > CHUNK:
                    yield chunk()
                    done, held, ids, counts, frames = start, 0, [], [], []
                ids.append(doc_id)
                counts.append(len(serialized) // width)
                frames.append(frame)
                held += len(frame)
                start += counts[-1]
        if frames:
            yield chunk()

    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(pack, CHUNK_SCHEMA).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(f"{path}/chunks")


def open_store(spark: SparkSession, path: str):
    """The chunks and the dictionary row of a store."""
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/dictionary").first()


def frames_of(doc_ids, counts, offsets, frames: bytes, start: int, decompressor) -> Iterator[tuple]:
    """Every document of a chunk: id, ids before it in the shard, number of ids, serialized ids."""
    view, ends = memoryview(frames), [*offsets[1:], len(frames)]
    for doc_id, n, a, b in zip(doc_ids, counts, offsets, ends, strict=True):
        yield doc_id, start, n, decompressor.decompress(view[a:b])
        start += n


def decompressor_of(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: ``doc_id``, ``shard``, ``local_start``, ``n_tokens``, ``ids`` (u32 bytes)."""
    chunks, about = open_store(spark, path)
    dictionary, width, sha = bytes(about["dictionary"]), about["width"], about["dict_sha256"]
    names = ["doc_id", "shard", "local_start", "n_tokens", "ids"]
    shared = spark.sparkContext.broadcast(dictionary)

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = decompressor_of(shared.value)
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            if row["dict_sha256"] != sha:
                raise ValueError("a chunk was written with another dictionary")
            docs = list(frames_of(row["doc_ids"], row["n_tokens"], row["offsets"], row["frames"], row["shard_start"], decompressor))
            ids = [np.frombuffer(d[3], f"<u{width}").astype("<u4").tobytes() for d in docs]
            columns = [pa.array([d[0] for d in docs], pa.int64()), pa.array([row["shard"]] * len(docs), pa.int32()), pa.array([d[1] for d in docs], pa.int64()), pa.array([d[2] for d in docs], pa.int64()), pa.array(ids, pa.binary())]
            yield from slices([pa.RecordBatch.from_arrays(columns, names=names)])

    return chunks.mapInArrow(unpack, "doc_id long, shard int, local_start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each stored row of one document; only its chunk is read, only its frame is opened."""
    chunks, about = open_store(spark, path)
    decompressor, found = decompressor_of(bytes(about["dictionary"])), []
    for row in chunks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).toLocalIterator():
        ends = [*row["offsets"][1:], len(row["frames"])]
        for d, a, b in zip(row["doc_ids"], row["offsets"], ends, strict=True):
            if d == doc_id:
                found.append(np.frombuffer(decompressor.decompress(bytes(row["frames"][a:b])), f"<u{about['width']}").tolist())
    return found


def layout(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files alone.

    The start of a shard is the sum over the shards before it: one row per shard, ordered in one window."""
    docs = read_store(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    chunks, _ = open_store(spark, path)
    totals = chunks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_before"))
    return docs.join(before, "shard").select("doc_id", (F.col("shard_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def stored_layout(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and describe what its files hold."""
    path = shared_folder(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer_path, end_id)
    return layout(docs.sparkSession, path)
