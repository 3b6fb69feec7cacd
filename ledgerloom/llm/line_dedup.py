"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines lie within one edit exactly if a string is left of both after at most one deletion each. A line's
neighbourhood is the line and all strings that lack one of its characters. Lines that share a neighbour by
deletions at the same place, or where one line is itself the neighbour, are within one edit; others that
share it also share such a one. All places of a run of equal characters leave the same string, so a deletion is
known by the span of its run, and lines share a place where their spans meet. So a group of lines around one
neighbour needs no pairs: its earliest lines decide.

Neighbourhoods are long, so they are spread only where a partner can exist: an edit leaves the first or the
second half of a line intact, and halves are counted first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import among, let, slices, stored, without

#: Shorter lines are duplicates of equal lines only: one edit would mean too much there.
MIN_CHARS = 20
#: What a shorter line needs to go: a letter or a digit.
WORD = r"[\p{L}\p{N}]"
#: Odd base of the rolling hash and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def halves(line: Column) -> list[Column]:
    """Keys of which two lines within one edit share one: first and second half, measured by the length of the
    shorter line of a pair, be it this one (0, 1) or one that lacks a character (2, 3)."""
    n = F.length(line)
    keys = []
    for anchor in (n, n - 1):
        half = F.floor(anchor / 2).cast("int")
        keys.append(F.xxhash64(anchor, F.lit("first"), F.substring(line, F.lit(1), half)))
        keys.append(F.xxhash64(anchor, F.lit("second"), F.right(line, anchor - half)))
    return keys


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def eligible(line: Column) -> Column:
    """Lines that can go: long ones by one edit, short ones with a word by an equal line."""
    return (F.length(line) >= MIN_CHARS) | line.rlike(WORD)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """Eligible lines once each: ``doc_id`` and ``place`` of the earliest, length ``n`` and the half keys ``k0`` to ``k3``.

    A line is known by hashes of 128 bits and its length; its text is not shuffled."""
    lines = docs.select("doc_id", F.posexplode_outer(split_lines(F.col("text"))).alias("place", "line")).where(eligible(F.col("line")))
    keyed = lines.select("doc_id", "place", F.xxhash64("line").alias("h"), F.length("line").alias("n"), *[k.alias(f"k{i}") for i, k in enumerate(halves(F.col("line")))])
    grouped = keyed.groupBy("h", "n", "k0", "k1", "k2", "k3").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    return grouped.select("first.doc_id", "first.place", "n", "k0", "k1", "k2", "k3")


def candidates(lines: DataFrame) -> DataFrame:
    """``doc_id`` and ``wanted``: places of long lines with a half that another one has, and that half's key."""
    keyed = lines.where(F.col("n") >= MIN_CHARS).select("doc_id", "place", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("kind", "key"))
    repeated = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keyed.join(repeated, "key").groupBy("doc_id").agg(F.collect_list(F.struct("place", "kind", "key")).alias("wanted"))


def neighbourhood(rest: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of what is left of a half by no deletion or by one, and the first and last place of it (-1 for none).

    The characters of a run leave the same string, so a run is one entry that spans its places."""
    m = len(rest)
    with np.errstate(over="ignore"):
        mixed = (rest.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(m, 1), BASE, np.uint64))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[1 : m + 1], dtype=np.uint64)])
        places = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]])) if m else np.zeros(0, np.int64)
        left = sums[places] + (sums[m] - sums[places + 1]) * np.uint64(INVERSE)
        sizes = np.concatenate([[np.uint64(m)], np.full(len(places), m - 1, np.uint64)])
        hashes = np.concatenate([sums[m:], left]) + sizes * np.uint64(0xA0761D6478BD642F) + np.uint64(key % (1 << 64))
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes.view(np.int64), np.concatenate([[-1], places]), np.concatenate([[-1], places[1:] - 1, [m - 1] * (m > 0)])


def variants(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``neighbour`` (hash), ``at`` and ``to`` (places of the deletion), ``doc_id`` and ``place`` for every candidate line."""
    names = ["neighbour", "at", "to", "doc_id", "place"]

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            parts = []
            for doc_id, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = (text or "").split("\n")
                for want in places:
                    if want["place"] >= len(lines):  # another version of the document has the line
                        continue
                    line, kind = np.frombuffer(lines[want["place"]].encode("utf-32-le"), np.uint32), want["kind"]
                    half = (len(line) - kind // 2) // 2
                    # a shared first half leaves the rest behind it, a shared second half what stands before it
                    rest = line[half:] if kind % 2 == 0 else line[: len(line) - (len(line) - kind // 2 - half)]
                    parts.append((*neighbourhood(rest, want["key"]), doc_id, want["place"]))
            if parts:
                sizes = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts])),
                        pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)),
                        pa.array(np.concatenate([p[2] for p in parts]).astype(np.int32)),
                        pa.array(np.repeat(np.array([p[3] for p in parts], np.int64), sizes)),
                        pa.array(np.repeat(np.array([p[4] for p in parts], np.int32), sizes)),
                    ],
                    names=names,
                )

    joined = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "wanted")
    return joined.mapInArrow(spread, "neighbour long, at int, to int, doc_id long, place int")


def near_pairs(spread: DataFrame) -> DataFrame:
    """A line (``doc_id``, ``place``) and an earlier one within one edit (``other``), without all pairs of a group.

    Each neighbour keeps the earliest line per span of deletion. A line meets the earliest of each span that shares
    a place with its own and the neighbour itself where that is a line; a line that is the neighbour meets the
    earliest of all."""
    order = F.struct("doc_id", "place")
    earliest = spread.groupBy("neighbour", "at", "to").agg(F.min(order).alias("lo"), F.count(F.lit(1)).alias("n"))
    grouped = earliest.groupBy("neighbour").agg(F.sum("n").alias("n"), F.collect_list(F.struct("at", "to", "lo")).alias("los")).where("n > 1").select("neighbour", "los")
    met = F.filter("los", lambda x: (F.col("at") == -1) | (x["at"] == -1) | ((x["at"] <= F.col("to")) & (x["to"] >= F.col("at"))))
    paired = spread.join(grouped, "neighbour").select("doc_id", "place", F.array_min(F.transform(met, lambda x: x["lo"])).alias("other"))
    return paired.where(F.col("other") < order).distinct()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines (``doc_id``, ``place``) whose earlier partner is truly within one edit."""
    line = lambda place: F.get(split_lines(F.col("text")), place)
    ids = pairs.select(F.explode(F.array("doc_id", "other.doc_id")).alias("doc_id")).distinct()
    texts = among(docs.select("doc_id", "text"), ids)
    own = texts.join(pairs, "doc_id").select(F.col("doc_id").alias("id__"), F.col("place").alias("place__"), line(F.col("place")).alias("own__"), F.col("other.doc_id").alias("doc_id"), F.col("other.place").alias("place"))
    both = texts.join(own, "doc_id").select("id__", "place__", "own__", line(F.col("place")).alias("other__"))
    return both.where(F.levenshtein("own__", "other__", 1) >= 0).select(F.col("id__").alias("doc_id"), F.col("place__").alias("place")).distinct()


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    Lines are compared over all documents in the order of ``doc_id`` and place. A line of at least
    ``MIN_CHARS`` characters goes if an earlier one equals it or lies within one edit of it, whether that one
    stays or not; the first of a chain stays. A shorter line with a letter or digit goes if an earlier one equals
    it; other short lines and empty ones stay. Lines are what ``\\n`` parts.

    A null text stays null and has no lines. Rows with a null ``doc_id`` stay whole and drop nothing. Rows of
    one ``doc_id`` are versions of one document: a place that stays in one stays in each. Input columns named
    like the results are replaced. A line in a third of all rows is one row per task before it is shuffled."""
    docs = without(docs, "n_lines", "n_removed", "keep__")
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = stored(distinct_lines(known), "distinct-lines")
    spread = variants(known, candidates(lines))
    pairs = stored(near_pairs(stored(spread, "neighbours")), "line-pairs")
    gone = stored(verified(known, pairs), "near-lines")
    # the places of a document are no more than its lines
    keep = lines.join(gone, ["doc_id", "place"], "left_anti").groupBy("doc_id").agg(F.collect_set("place").alias("keep__"))
    joined = docs.join(keep.withColumnRenamed("doc_id", "id__"), F.col("doc_id") == F.col("id__"), "left").drop("id__")
    held = F.coalesce("keep__", F.array().cast("array<int>"))
    parts = F.when(F.col("text").isNotNull(), split_lines(F.col("text")))
    stay = let(F.struct(parts.alias("lines"), held.alias("keep")), lambda s: F.filter(s["lines"], lambda line, i: ~eligible(line) | F.array_contains(s["keep"], i)))
    rest = F.when(F.col("doc_id").isNull(), parts).otherwise(stay)
    sized = joined.withColumns({"n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"), "rest__": rest})
    return sized.withColumns({"n_removed": F.col("n_lines") - F.coalesce(F.size("rest__"), F.lit(0)), "text": F.array_join("rest__", "\n")}).drop("rest__", "keep__")


def report(deduped: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed`` and SHA-256 of what is left of each text (null: empty)."""
    return deduped.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
