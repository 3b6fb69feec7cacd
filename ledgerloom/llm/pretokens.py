"""Pre-tokens and normal forms of the two public tokenizers, equal to what the tokenizers library finds.

The fast way is one compiled pattern. It covers texts whose characters lie in ranges where the character
classes of both sides are known to agree (a test compares them one by one); any other text takes the
library's own normalizer and pre-tokenizer, piece by piece."""

from __future__ import annotations

import re
import unicodedata

import regex
from tokenizers import Tokenizer

#: The two split patterns as the tokenizer files define them.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Latin, its extensions, common marks and general punctuation.
UNCOMMON = re.compile(r"[^\u0000-\u036f\u2000-\u206f\u20a0-\u20b9\u2122]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def special_splitter(tokenizer: Tokenizer):
    """A pattern that cuts a text at added tokens, and their ids; the longer token wins, as in the library."""
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    longest_first = sorted(added, key=lambda t: (-len(t), t))
    return re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None, added


class ByteSplitter:
    """Pre-tokens of the byte-level tokenizer."""

    #: Characters or places where a blank-led chunk is not cut from its neighbours by the pattern alone.
    irregular = re.compile(UNCOMMON.pattern + r"|[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f]|[ \n][ \n]|[ \n]\Z")
    #: A stop or comma that may belong to the pre-token before it.
    joined = re.compile(r"(?<![a-zA-Z0-9\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])[.,]")
    #: The same as ``irregular`` for ASCII texts, found faster one by one.
    ascii_irregular = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x00", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.find = regex.compile(BYTE_PATTERN).findall
        self.cut, self.added = special_splitter(tokenizer)

    def chunks(self, segment: str) -> list[str] | None:
        """Runs between blanks, each with its leading blank, and line ends: no pre-token spans two of them.

        A stop or comma behind a letter or digit begins a chunk of its own, as it begins a pre-token."""
        if segment.isascii():
            if segment[-1:] in (" ", "\n") or any(x in segment for x in self.ascii_irregular):
                return None
        elif self.irregular.search(segment):
            return None
        cut = segment.replace("\n", "\x00\n\x00").replace(" ", "\x00 ")
        return (cut if self.joined.search(segment) else cut.replace(".", "\x00.").replace(",", "\x00,")).split("\x00")

    def chunk_pieces(self, chunk: str) -> list[str]:
        return self.find(chunk)

    def pieces(self, segment: str) -> list[str]:
        if not UNCOMMON.search(segment):
            return self.find(segment)
        return [segment[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment)]


class WordSplitter:
    """Words of the lower-casing tokenizer."""

    irregular = re.compile(UNCOMMON.pattern + r"|[\x1c-\x1f]")

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.find = regex.compile(WORD_PATTERN).findall
        self.cut, self.added = special_splitter(tokenizer)
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}

    def chunks(self, segment: str) -> list[str] | None:
        """Runs between white space: no word and no composed letter spans two of them."""
        return None if self.irregular.search(segment) else segment.split()

    def chunk_pieces(self, chunk: str) -> list[str]:
        return self.find(unicodedata.normalize("NFC", chunk).lower())

    def pieces(self, segment: str) -> list[str]:
        if not UNCOMMON.search(segment):
            return self.find(unicodedata.normalize("NFC", segment).lower())
        normal = self.tokenizer.normalizer.normalize_str(segment)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(self.byte_of[c] for c in piece).decode("utf-8") for piece, _ in split]


#: Characters of a chunk or pre-token that a worker remembers; longer ones are worked out each time.
LONGEST_KEPT = 64


class Known(dict):
    """Values by key; a key that is not known is noted and stands for nothing."""

    def __init__(self, values: dict, nothing):
        super().__init__(values)
        self.nothing, self.missing = nothing, []

    def __missing__(self, key):
        self.missing.append(key)
        return self.nothing


class PieceTable:
    """A worker's memory of values of pre-tokens and of chunks, joined to values of whole texts.

    ``encode`` gives the values of new pre-tokens, ``join`` the value of a sequence, ``special`` that of an
    added token. ``fixed`` values stay; all others are forgotten when more than ``limit`` are held."""

    def __init__(self, splitter, encode, join, special, fixed: dict | None = None, limit: int = 1_200_000):
        self.splitter, self.encode, self.join, self.special = splitter, encode, join, special
        self.fixed, self.limit = fixed or {}, limit
        self.forget()

    def forget(self) -> None:
        # a pre-token that is also a chunk has one value, so one table holds both
        nothing = self.join([])
        self.known = Known(self.fixed | {"": nothing}, nothing)

    def plan(self, text: str | None) -> list[tuple]:
        """Parts of a text: (kind, chunks or pre-tokens), or (special, value)."""
        splitter, parts = self.splitter, []
        segments = splitter.cut.split(text) if text and splitter.cut and "<|" in text else [text or ""]
        for k, segment in enumerate(segments):
            if k % 2:
                parts.append(("special", self.special(splitter.added[segment])))
            else:
                chunks = splitter.chunks(segment)
                parts.append(("pieces", splitter.pieces(segment)) if chunks is None else ("chunks", chunks))
        return parts

    def values(self, texts: list[str | None]) -> list:
        """The values of whole texts, in order."""
        if len(self.known) > self.limit + len(self.fixed):
            self.forget()
        plans = [self.plan(t) for t in texts]
        chunks, pieces, out, missed = set(), set(), [], []
        for k, plan in enumerate(plans):
            value, new = self.joined(plan, chunks, pieces)
            out.append(value)
            if new:
                missed.append(k)
        if missed:
            passing = self.learn(chunks, pieces)
            for k in missed:
                out[k] = self.joined(plans[k], chunks, pieces)[0]
            for long in passing:
                del self.known[long]
        return out

    def joined(self, plan: list[tuple], chunks: set, pieces: set) -> tuple:
        """The value of a planned text, and whether a chunk or pre-token was not known; those join the sets."""
        known, parts, new = self.known, [], False
        for kind, items in plan:
            if kind == "special":
                parts.append(items)
                continue
            parts.append(self.join(map(known.__getitem__, items)))
            if known.missing:
                (chunks if kind == "chunks" else pieces).update(known.missing)
                known.missing.clear()
                new = True
        return (parts[0] if len(parts) == 1 else self.join(parts)), new

    def learn(self, chunks: set, pieces: set) -> list[str]:
        """Add chunks and pre-tokens that are not known; returns those too long to be kept."""
        known = self.known
        split = dict(zip(chunks, map(self.splitter.chunk_pieces, chunks), strict=True))
        new = [p for p in pieces.union(*split.values()) if p not in known]
        known.update(zip(new, self.encode(new), strict=True))
        value = known.__getitem__
        whole = {c: self.join(map(value, ps)) for c, ps in split.items() if c not in known}
        known.update(whole)
        return [k for k in (*new, *whole) if len(k) > LONGEST_KEPT]
