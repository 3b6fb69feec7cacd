"""Ids of whole texts by the byte-level tokenizer, for many texts at once.

The bytes of all texts are cut in one numpy pass at places where a pre-token surely ends, whatever stands
elsewhere. Arrow finds equal chunks; those that the worker has not seen before go to the tokenizers library,
which alone decides on pre-tokens and merges. Texts with added tokens are cut at fewer places, and so are those
where unusual white space meets plain white space or an end of the text, as a cut could part a run of both."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.pretokens import LONGEST_KEPT, ByteSplitter

#: Bytes of text that are worked on at once, at least one text.
GROUP = 2 << 20
#: Ranges of code points beyond blank and the five control white spaces that a class of white space may hold.
UNUSUAL_SPACES = ((0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
#: Kinds of bytes; those of characters beyond ASCII are of none.
MARK, LETTER, SPACE = 1, 2, 3


def byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[:128] = MARK
    kinds[[b for b in range(128) if chr(b).isalnum()]] = LETTER
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    return kinds


class ChunkTable:
    """A worker's memory of the serialized ids of chunks; all are forgotten when more than ``limit`` are held."""

    kinds = byte_kinds()

    def __init__(self, splitter: ByteSplitter, width: int, limit: int):
        self.tokenizer, self.width, self.limit = splitter.tokenizer, width, limit
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        unusual = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in UNUSUAL_SPACES) + "]"
        self.rare = "|".join([rf"\A{unusual}", rf"[\t-\r ]{unusual}", rf"{unusual}[\t-\r ]", rf"{unusual}\z", *map(re.escape, splitter.added)])
        # a blank between plain letters or digits leads a pre-token, and no added token may hold it
        between = re.compile(r"(?<=[a-zA-Z0-9])(?= [a-zA-Z0-9])")
        self.parts = (lambda text: [text]) if any(map(between.search, splitter.added)) else between.split
        self.line_end = self.library([b"\n"])[0]
        self.known: dict[bytes, bytes] = {}

    def library(self, texts: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in encoded]

    def values(self, texts: pa.Array) -> Iterator[bytes]:
        """The serialized ids of each text, in order; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, "right")))
            yield from self.group(texts.slice(at, stop - at))
            at = stop

    def group(self, texts: pa.Array) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {}
        rare = pc.match_substring_regex(texts, self.rare)
        out = iter(self.chunked(texts.filter(pc.invert(rare)).cast(pa.large_binary())))
        return [self.parted(texts[k].as_py()) if r else next(out) for k, r in enumerate(rare.to_pylist())]

    def parted(self, text: str) -> bytes:
        parts = [p.encode("utf-8") for p in self.parts(text)]
        distinct = list(dict.fromkeys(parts))
        ids = dict(zip(distinct, self.ids_of(distinct, self.library), strict=True))
        return b"".join(map(ids.__getitem__, parts))

    def ids_of(self, keys: list[bytes], learn: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The ids of distinct chunks or parts, by ``learn`` where they are not known."""
        found = list(map(self.known.get, keys))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, learn([keys[k] for k in new]), strict=True):
            found[k] = ids
            if len(keys[k]) <= LONGEST_KEPT:
                self.known[keys[k]] = ids
        return found

    def chunked(self, texts: pa.Array) -> list[bytes]:
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if bounds[0] == bounds[-1]:
            return [b""] * len(texts)
        data, bounds = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
        starts = self.cuts(data, bounds)
        ids = self.chunk_ids(data, np.append(starts, len(data)))
        # where the chunks of each text begin among the serialized ids
        places = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(starts, bounds)].tolist()
        packed = memoryview(ids.buffers()[2])
        return [bytes(packed[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of chunks.

        A run of white space is one pre-token but for its last character, which leads the next word if it is
        a blank and stands alone if not; at the end of a text it is one. A mark behind a letter or digit
        begins a pre-token."""
        kinds = self.kinds[data]
        space, letter = kinds == SPACE, kinds == LETTER
        # Latin letters of two bytes, by their second byte
        leads = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
        points = (data[leads].astype(np.int32) & 0x1F) << 6 | data[leads + 1] & 0x3F
        letter[leads[(points < 0x250) & (points != 0xD7) & (points != 0xF7)] + 1] = True
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        cut, last = first[:-1].copy(), space[:-1] & ~space[1:]
        cut[1:] |= (space[1:] & ~space[:-1]) | (letter[:-1] & (kinds[1:] == MARK)) | (last & (data[:-1] != 0x20))
        cut[:-1] |= last & ~first[1:-1]
        return np.flatnonzero(cut)

    def chunk_ids(self, data: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The serialized ids of every chunk."""
        chunks = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        _, ends, distinct = coded.dictionary.buffers()
        ends, distinct = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1].tolist(), distinct.to_pybytes()
        keys = [distinct[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.array(self.ids_of(keys, self.learn), pa.large_binary()).take(coded.indices)

    def learn(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of new chunks from the library: as lines of one text, as a single line end is a pre-token of its own."""
        lines, blank = [c for c in chunks if c.strip()], [c for c in chunks if not c.strip()]
        found = dict(zip(blank, self.library(blank), strict=True))
        if lines:
            (packed,) = self.library([b"\n".join(lines)])
            ids, (line_end,) = (np.frombuffer(b, f"<u{self.width}") for b in (packed, self.line_end))
            ends = np.flatnonzero(ids == line_end) * self.width
            starts = [0, *(ends + self.width).tolist()]
            found |= zip(lines, (packed[a:b] for a, b in zip(starts, [*ends.tolist(), len(packed)], strict=True)), strict=True)
        return [found[c] for c in chunks]
