"""Token counts by a two-tier lookup of pre-token lengths, with no shuffle of pre-tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from ledgerloom.llm.common import file_bytes, slices, without
from ledgerloom.llm.pretokens import ByteSplitter, PieceTable, byte_letters


def frequent_lengths(definition: bytes) -> dict[str, int]:
    """Tokens per pre-token for the pre-tokens a tokenizer has learnt as frequent: whole vocabulary entries.

    The table has at most one entry per token of the vocabulary, so its size never follows the corpus. The
    length comes from the library, as an entry need not be what the merges lead to."""
    tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
    splitter, byte_of = ByteSplitter(tokenizer), {c: b for b, c in enumerate(byte_letters())}
    pieces = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            piece = bytes(byte_of[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if splitter.pieces(piece) == [piece]:
            pieces.append(piece)
    return {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)}


def length_table(definition: bytes, frequent: dict[str, int]) -> PieceTable:
    """First tier: the broadcast lengths. Second tier: the worker's cache, which encodes each miss once."""
    tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
    encode = lambda pieces: [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
    return PieceTable(ByteSplitter(tokenizer), encode, sum, lambda _: 1, frequent)


_WORKER: dict[str, PieceTable] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Columns of ``docs`` without the text, plus ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay, each with its own count; an empty
    table gives an empty result. Input columns named like the three results are replaced by them. Every
    text is counted whole, in the map task that reads it."""
    spark = docs.sparkSession
    definition = file_bytes(tokenizer_path)
    shared = spark.sparkContext.broadcast((definition, frequent_lengths(definition)))
    kept = without(docs, "n_bytes", "n_tokens", "over_limit", text)
    ready = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("n_tokens"))
    names, digest = ready.columns, hashlib.sha256(definition).hexdigest()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _WORKER:
            _WORKER.clear()
            _WORKER[digest] = length_table(*shared.value)
        for batch in slices(batches):
            counts = pa.array(_WORKER[digest].values(batch.column(batch.num_columns - 1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=names)

    schema = StructType([*ready.schema.fields[:-1], StructField("n_tokens", LongType())])
    return ready.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
