"""Pairs of texts compared in numpy, many at once.

Edit distances are exact: bits of machine words stand for rows of the cost table (Myers, Hyyrö)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

#: Pairs that move through the table together, and bytes of their letter masks at most.
PAIRS, MASK_BYTES = 2048, 1 << 25
ONE, TOP = np.uint64(1), np.uint64(63)
#: Fewer pairs than so many per machine word of the pattern are cheaper one by one.
FEW = 25


def _kept(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, blank: int) -> np.ndarray:
    """The sequences as rows of a table, filled up with ``blank``."""
    out = np.full((len(starts), width), blank, dtype=letters.dtype)
    inside = np.arange(width) < lengths[:, None]
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[inside] = letters[np.repeat(starts, lengths) + place]
    return out


def _block(pattern: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray, kinds: int) -> np.ndarray:
    """Distances of pairs with longest ``other`` first, whose patterns are equally many machine words long."""
    rows, words = len(n), pattern.shape[1] // 64
    masks = np.zeros((rows, words, kinds + 1), np.uint64)
    each = np.arange(rows)
    for i in range(int(n.max())):
        masks[each, i // 64, pattern[:, i]] |= ONE << np.uint64(i % 64)
    masks[:, :, kinds] = 0  # what fills up the patterns
    up, down = np.full((words, rows), ~np.uint64(0)), np.zeros((words, rows), np.uint64)
    last, score = ((n - 1) % 64).astype(np.uint64), n.astype(np.int64)
    active = np.searchsorted(-m, -np.arange(1, int(m.max()) + 1), side="right")
    for j, k in enumerate(active.tolist()):
        plus, minus, letter = np.ones(k, np.uint64), np.zeros(k, np.uint64), other[:k, j]
        for w in range(words):
            equal, p, q = masks[each[:k], w, letter], up[w, :k], down[w, :k]
            vertical = equal | q
            equal |= minus
            across = (((equal & p) + p) ^ p) | equal
            more, less = q | ~(across | p), p & across
            if w == words - 1:
                score[:k] += ((more >> last[:k]) & ONE).astype(np.int64) - ((less >> last[:k]) & ONE).astype(np.int64)
            more_in, less_in = plus, minus
            plus, minus = more >> TOP, less >> TOP
            more = (more << ONE) | more_in
            up[w, :k] = (less << ONE) | less_in | ~(vertical | more)
            down[w, :k] = more & vertical
    return score


def _single(pattern: list[int], other: list[int]) -> int:
    """Distance of one pair: one whole number holds a column of the table, however long."""
    masks: dict[int, int] = {}
    for i, letter in enumerate(pattern):
        masks[letter] = masks.get(letter, 0) | 1 << i
    score, full, top = len(pattern), (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down = full, 0
    for letter in other:
        equal = masks.get(letter, 0)
        vertical, across = equal | down, (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(across | up)), up & across
        score += 1 if more & top else -1 if less & top else 0
        more = more << 1 | 1
        up, down = full & (less << 1 | ~(vertical | more)), full & more & vertical
    return score


def distances(left: np.ndarray, n: np.ndarray, right: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distance of every pair; ``left`` and ``right`` are all sequences of a side end to end, as small numbers."""
    a, b = np.cumsum(n) - n, np.cumsum(m) - m
    out = np.where(n == 0, m, n).astype(np.int64)
    pairs = np.flatnonzero((n > 0) & (m > 0))
    if not len(pairs):
        return out
    # The shorter side is the pattern, whose length counts in machine words.
    letters, turned = np.concatenate([left, right]), n > m
    b = b + len(left)
    start, other_start = np.where(turned, b, a), np.where(turned, a, b)
    short, long = np.minimum(n, m), np.maximum(n, m)
    words = -(-short // 64)
    order, at = pairs[np.lexsort((-long[pairs], words[pairs]))], 0
    while at < len(order):
        w = int(words[order[at]])
        part = order[at : at + PAIRS]
        part = part[words[part] == w]
        if len(part) < FEW * w:
            for k in part:
                out[k] = _single(letters[start[k] : start[k] + short[k]].tolist(), letters[other_start[k] : other_start[k] + long[k]].tolist())
            at += len(part)
            continue
        # Numbers of a slice are dealt anew, so that their masks are few.
        size = len(part)
        while True:
            part = part[:size]
            first = _kept(letters, start[part], short[part], w * 64, -1)
            second = _kept(letters, other_start[part], long[part], int(long[part].max()), -1)
            known = np.zeros(int(max(first.max(), second.max())) + 2, np.int32)
            known[first.ravel()], known[second.ravel()] = 1, 1
            known[-1] = 0
            kinds = int(known.sum())
            if size == 1 or size * w * (kinds + 1) * 8 <= MASK_BYTES:
                break
            size = max(1, size // 2)
        known = np.where(known > 0, np.cumsum(known) - 1, kinds)
        out[part] = _block(known[first], short[part], known[second], long[part], kinds)
        at += size
    return out


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts end to end and their number in each."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(texts.to_pylist())
    kind = np.uint8 if joined.isascii() else np.uint32
    letters = np.frombuffer(joined.encode("ascii" if joined.isascii() else "utf-32-le"), kind)
    return letters.astype(np.int32), lengths


def _numbered(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of both sides as numbers; equal words of a pair have one number."""
    sides, sizes = ([], []), ([], [])
    for texts in zip(left, right, strict=True):
        known: dict[bytes, int] = {}
        for k, text in enumerate(texts):
            found = text.encode().split()
            sides[k].extend([known.setdefault(word, len(known)) for word in found])
            sizes[k].append(len(found))
    a, b = (np.array(side, np.int32) for side in sides)
    return a, np.array(sizes[0], np.int64), b, np.array(sizes[1], np.int64)


def _of_known(left: pa.Array, right: pa.Array, work) -> pa.Array:
    """``work`` over the pairs of which neither side is null; the others are null."""
    known = pc.and_(pc.is_valid(left), pc.is_valid(right))
    found = work(left.filter(known), right.filter(known))
    out = np.zeros(len(left), found.dtype)
    mask = known.to_numpy(zero_copy_only=False)
    out[mask] = found
    return pa.array(out, mask=~mask)


@F.arrow_udf(IntegerType())
def edits(left: pa.Array, right: pa.Array) -> pa.Array:
    """Edit distance of two texts in letters."""

    def work(a: pa.Array, b: pa.Array) -> np.ndarray:
        x, n = _flat(a)
        y, m = _flat(b)
        return distances(x, n, y, m).astype(np.int32)

    return _of_known(left, right, work)


@F.arrow_udf(DoubleType())
def word_error_rate(reference: pa.Array, prediction: pa.Array) -> pa.Array:
    """Edit distance of two texts in words, per word of the reference."""

    def work(a: pa.Array, b: pa.Array) -> np.ndarray:
        x, n, y, m = _numbered(a.to_pylist(), b.to_pylist())
        return distances(x, n, y, m) / np.maximum(n, 1)

    return _of_known(reference, prediction, work)


def shared_letters(letters: str):
    """Of two texts, how many of ``letters`` each has (``a``, ``b``) and how many of them meet an equal one (``hits``).

    A null text has no number of its own and leaves the other's as hits."""
    known = "".join(dict.fromkeys(letters))
    place = [known.index(x) for x in letters]

    def counted(texts: pa.Array) -> np.ndarray:
        kinds = np.full(0x110000, -1, np.int8)
        kinds[[ord(x) for x in known]] = np.arange(len(known))
        codes, lengths = _flat(texts.fill_null(""))
        kind = kinds[codes]
        own = np.flatnonzero(kind >= 0)
        row = np.searchsorted(np.cumsum(lengths), own, side="right")
        return np.bincount(row * len(known) + kind[own], minlength=len(texts) * len(known)).reshape(len(texts), -1)[:, place]

    @F.arrow_udf(StructType.fromDDL("a int, b int, hits int"))
    def shared(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = counted(left), counted(right)
        no_x, no_y = (side.is_null().to_numpy(zero_copy_only=False) for side in (left, right))
        hits = np.minimum(np.where(no_x[:, None], y, x), np.where(no_y[:, None], x, y)).sum(axis=1)
        columns = ((x.sum(axis=1), no_x), (y.sum(axis=1), no_y), (hits, no_x & no_y))
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int32), mask=m) for c, m in columns], names=["a", "b", "hits"])

    return shared
