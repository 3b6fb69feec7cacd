"""Byte-pair encoding in batched merge rounds, and decoding.

The symbols of many words lie in one flat array. A round looks all neighbouring pairs up by binary search in
the sorted pair keys of the merge list, takes the lowest rank of each word and merges that pair wherever it
stands in the word. Words without a known pair leave the array; the rounds end when none is left. Very long words
are merged by a heap of their pairs instead."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from tokenizers import Tokenizer

from ledgerloom.llm.common import file_bytes, slices, without
from ledgerloom.llm.pretokens import PieceTable, WordSplitter, byte_letters

#: Bytes of the longest word that is merged in the flat array.
LONG_WORD = 256
NO_RANK = np.iinfo(np.int64).max


class Merges:
    """The merge list as sorted arrays, and the first symbols of a word's bytes."""

    def __init__(self, definition: bytes):
        model = json.loads(definition)["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8") for w in words]
        long = [k for k, b in enumerate(raw) if len(b) > LONG_WORD]
        if long:
            # a round costs the length of a word and merges one pair of it: long words go by a heap
            found = iter(self.flat([b for b in raw if len(b) <= LONG_WORD]))
            return [self.heaped(b) if len(b) > LONG_WORD else next(found) for b in raw]
        return self.flat(raw)

    def flat(self, raw: list[bytes]) -> list[bytes]:
        """Ids of short words, all in one flat array."""
        if not raw:
            return []
        sizes = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), sizes)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends[sizes > 0]] = self.last[data[ends[sizes > 0]]]
        done_symbols, done_owner = [], []
        while len(symbols):
            symbols, owner, finished = self.round(symbols, owner)
            done_symbols.append(finished[0])
            done_owner.append(finished[1])
        order = np.argsort(flat := np.concatenate(done_owner), kind="stable") if done_owner else np.zeros(0, np.int64)
        ids = np.concatenate(done_symbols)[order].astype("<u4") if done_symbols else np.zeros(0, "<u4")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(raw)))]) * 4 if done_owner else np.zeros(len(raw) + 1, np.int64)
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    @cached_property
    def by_pair(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def heaped(self, word: bytes) -> bytes:
        """Ids of one long word: its pairs wait in a heap by rank and place, merged symbols are linked."""
        data = np.frombuffer(word, np.uint8)
        symbols, n = self.inner[data].tolist(), len(data)
        symbols[-1] = int(self.last[data[-1]])
        before, behind, ranks, made = list(range(-1, n - 1)), list(range(1, n + 1)), self.by_pair, self.made
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(symbols[k] << 32 | symbols[k + 1])) is not None]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            right = behind[k]
            # a pair is stale when one of its symbols has changed since
            if symbols[k] is None or right >= n or ranks.get(symbols[k] << 32 | symbols[right]) != rank:
                continue
            symbols[k], symbols[right], behind[k] = int(made[rank]), None, behind[right]
            if behind[k] < n:
                before[behind[k]] = k
            for left in (before[k], k):
                if left >= 0 and behind[left] < n and (r := ranks.get(symbols[left] << 32 | symbols[behind[left]])) is not None:
                    heappush(heap, (r, left))
        return np.array([x for x in symbols if x is not None], "<u4").tobytes()

    def round(self, symbols: np.ndarray, owner: np.ndarray):
        """One merge in every word that has one; the other words come back as finished."""
        paired = owner[:-1] == owner[1:]
        keys = np.where(paired, symbols[:-1] << 32 | symbols[1:], -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        ranks = np.append(np.where(self.keys[at] == keys, self.ranks[at], NO_RANK), NO_RANK)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lengths = np.diff(np.append(starts, len(owner)))
        lowest = np.repeat(np.minimum.reduceat(ranks, starts), lengths)
        live = lowest != NO_RANK
        chosen = np.flatnonzero((ranks == lowest) & live)
        # in a run of overlapping choices, as in aaa, every second one from its left end counts
        run = np.cumsum(np.concatenate([[True], np.diff(chosen) != 1])) - 1 if len(chosen) else chosen
        first = chosen[np.concatenate([[True], np.diff(run) != 0])] if len(chosen) else chosen
        chosen = chosen[(chosen - first[run]) % 2 == 0] if len(chosen) else chosen
        merged = symbols.copy()
        merged[chosen] = self.made[ranks[chosen]]
        stays = live.copy()
        stays[chosen + 1] = False
        return merged[stays], owner[stays], (symbols[~live], owner[~live])


def id_table(definition: bytes, splitter=WordSplitter, width: int = 4, limit: int = 500_000) -> PieceTable:
    """A worker's table from words to serialized ids of ``width`` bytes; added tokens keep their own id."""
    merges = Merges(definition)
    encode = merges.encode if width == 4 else lambda words: [np.frombuffer(b, "<u4").astype(f"<u{width}").tobytes() for b in merges.encode(words)]
    return PieceTable(splitter(Tokenizer.from_str(definition.decode("utf-8"))), encode, b"".join, lambda i: i.to_bytes(width, "little"), limit=limit)


def token_texts(definition: bytes) -> list[str]:
    """The text of each id, added tokens included."""
    tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
    table = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return [table.get(i, "") for i in range(max(table) + 1)]


_WORKER: dict[tuple[str, str], object] = {}


def worker_copy(kind: str, digest: str, make):
    """One object a worker for each tokenizer file."""
    if (kind, digest) not in _WORKER:
        _WORKER[kind, digest] = make()
    return _WORKER[kind, digest]


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``ids``: binary, little-endian unsigned 32-bit integers.

    Whole texts are encoded in the task that reads them, without begin or end tokens, cut or padding. Null
    and empty texts give empty ids; repeated rows stay; an input column ``ids`` is replaced."""
    definition = file_bytes(tokenizer_path)
    digest, shared = hashlib.sha256(definition).hexdigest(), docs.sparkSession.sparkContext.broadcast(definition)
    kept = without(docs, "ids", text)
    ready = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(text).cast("string").alias("ids"))
    names = ready.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_copy("ids", digest, lambda: id_table(shared.value))
        for batch in slices(batches):
            ids = pa.array(table.values(batch.column(batch.num_columns - 1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=names)

    return ready.mapInArrow(run, StructType([*ready.schema.fields[:-1], StructField("ids", BinaryType())]))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` plus ``text``: the tokens of ``ids``, joined by blanks as a tokenizer without decoder does.

    Special tokens are kept. Null or empty ids give an empty text; an input column ``text`` is replaced."""
    definition = file_bytes(tokenizer_path)
    digest, shared = hashlib.sha256(definition).hexdigest(), encoded.sparkSession.sparkContext.broadcast(definition)
    ready = without(encoded, "text")
    names, place = [*ready.columns, "text"], [c.lower() for c in ready.columns].index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_copy("texts", digest, lambda: token_texts(shared.value))
        for batch in slices(batches):
            texts = [" ".join(map(table.__getitem__, np.frombuffer(b or b"", "<u4").tolist())) for b in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return ready.mapInArrow(run, StructType([*ready.schema.fields, StructField("text", StringType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id``, number of ids, and SHA-256 of ids and decoded text."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
