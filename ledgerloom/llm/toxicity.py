"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerloom.llm.common import id_remainder, slices, stored, without

#: Character n-grams from ``SHORTEST`` to ``LONGEST`` letters, hashed to ``SPACE`` places.
SHORTEST, LONGEST, SPACE = 3, 5, 1 << 19
#: A feature is an n-gram seen at least so often in a text: one block of ``SPACE`` features a grade.
GRADES = (1, 2)
FEATURES = SPACE * len(GRADES)
#: Labelled texts that a feature needs, and the smoothing of its counts.
LEAST_TEXTS, SMOOTHING = 4, 1.0
#: Labelled rows that fit ratios and weights at most, and rows of one leader.
TRAIN_ROWS, SHARD_ROWS = 16_384, 4_096
#: Step, smoothing and penalties of the updates, passes over the rows, and the power of a text's size that divides.
ALPHA, BETA, L1, L2, PASSES, NORM = 1.0, 1.0, 1.0, 0.1, 3, 0.25
#: Letters hashed at once; longer texts go piece by piece.
PIECE = 1 << 20


def places(letters: np.ndarray, starts: int) -> np.ndarray:
    """Hash places of the n-grams of every length that begin at the first ``starts`` letters."""
    spread = letters * np.uint32(0x9E3779B1)
    rolled, found = spread, []
    for n in range(2, LONGEST + 1):
        if len(rolled) < 2:
            break
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + spread[n - 1 :]
        if n >= SHORTEST:
            mixed = (rolled[:starts] ^ (rolled[:starts] >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            found.append(mixed >> np.uint32(32 - SPACE.bit_length() + 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def features(text: str | None) -> np.ndarray:
    """Features of a whole text: lower-cased, white space as one blank, a blank at either end; null is empty."""
    letters = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    if len(letters) <= PIECE:
        place, count = np.unique(places(letters, len(letters)), return_counts=True)
    else:
        total = np.zeros(SPACE, np.int64)
        for at in range(0, len(letters), PIECE):
            total += np.bincount(places(letters[at : at + PIECE + LONGEST - 1], PIECE), minlength=SPACE)
        place = np.flatnonzero(total)
        count = total[place]
    return np.concatenate([place[count >= least] + grade * SPACE for grade, least in enumerate(GRADES)]).astype(np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, divisor: int, held_out: int, rows: int) -> DataFrame:
    """``doc_id``, ``text``, ``label__`` and ``shard`` of the rows that teach, written once.

    Ids are chosen by a hash, about ``rows`` of them at most, so their table is small enough to broadcast and no
    other text is shuffled. The larger of several labels of an id counts, and the least of its texts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), divisor) != held_out))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label__"))
    size = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-size // rows)))) == 0)
    shards = max(1, round(min(size, rows) / SHARD_ROWS))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.col("label__") > 0).cast("int").alias("label__"))
    return stored(one.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards))), "toxic-sample")


def log_ratios(rows: DataFrame) -> np.ndarray:
    """The log-count ratio of every feature over the rows that teach; zero where fewer than ``LEAST_TEXTS`` have it.

    Each task adds up its rows; Spark sums the tasks' counts, and the driver gets one row per feature at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros((2, FEATURES), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(label), features(text)] += 1
                texts[int(label)] += 1
        found = np.flatnonzero(seen.any(axis=0))
        columns = [np.append(found, FEATURES).astype(np.int32), np.append(seen[0, found], texts[0]).astype(np.int64), np.append(seen[1, found], texts[1]).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "clean", "toxic"])

    counts = rows.select("text", "label__").mapInArrow(count, "feature int, clean long, toxic long")
    summed = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    summed = summed.where((F.col("clean") + F.col("toxic") >= LEAST_TEXTS) | (F.col("feature") == FEATURES)).toArrow()
    feature, clean, toxic = (summed.column(c).to_numpy() for c in ("feature", "clean", "toxic"))
    texts = [int(c[feature == FEATURES].sum()) for c in (clean, toxic)]
    real = feature < FEATURES
    ratios = np.zeros(FEATURES, np.float32)
    ratios[feature[real]] = np.log((toxic[real] + SMOOTHING) / (texts[1] + 2 * SMOOTHING)) - np.log((clean[real] + SMOOTHING) / (texts[0] + 2 * SMOOTHING))
    return ratios


class Leader:
    """Follow-the-regularised-leader over scaled features; the last weight is that of a constant."""

    def __init__(self):
        self.z, self.n = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        weights = self.weights(index)
        gradient = (1 / (1 + np.exp(-np.clip(weights @ value, -35, 35))) - label) * value
        grown = self.n[index] + gradient * gradient
        self.z[index] += gradient - (np.sqrt(grown) - np.sqrt(self.n[index])) / ALPHA * weights
        self.n[index] = grown


def train(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of all features, ratios included, and of the constant, from rows whose remainder is not ``held_out``.

    At most about ``rows`` labelled rows fit ratios and weights (``TRAIN_ROWS``), chosen by a hash of the id. The
    weights come from shards of about ``SHARD_ROWS``: a shard is a column, so the same rows meet the same leader
    however Spark deals them, and a leader sees its rows in the order of a hash. The shards' weights are averaged
    by Spark. Without labelled rows all weights are zero and every score is 0.5."""
    known = training_rows(docs, labels, divisor, held_out, rows)
    ratios = log_ratios(known)
    ordered = known.select("shard", F.xxhash64("doc_id", F.lit(7)).alias("place"), "doc_id", "text", F.col("label__").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def fit(table: pa.Table) -> pa.Table:
        table, scale = table.sort_by([(c, "ascending") for c in ("place", "doc_id")]), np.append(shared.value, np.float32(1))
        leader, held = Leader(), []
        for k in range(table.num_rows):
            found = features(table.column("text")[k].as_py())
            used = found[scale[found] != 0]
            held.append((np.append(used, np.int32(FEATURES)), np.float32(len(found) ** NORM), table.column("label")[k].as_py()))
        for _ in range(PASSES):
            for index, size, label in held:
                value = scale[index] / size
                value[-1] = 1
                leader.learn(index, value.astype(float), label)
        learnt = leader.weights() * scale
        index = np.flatnonzero(learnt)
        # a shard is counted by an index of its own, as one without any weight counts too
        return pa.table({"index": np.append(index, FEATURES + 1).astype(np.int32), "weight": np.append(learnt[index], 1.0)})

    summed = ordered.groupBy("shard").applyInArrow(fit, "index int, weight double").groupBy("index").agg(F.sum("weight").alias("weight")).toArrow()
    sums = np.zeros(FEATURES + 2)
    sums[summed.column("index").to_numpy()] = summed.column("weight").to_numpy()
    return sums[: FEATURES + 1] / max(sums[FEATURES + 1], 1)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``score`` from 0 to 1 of every whole text.

    Null and empty texts have no n-gram and get the constant's score; repeated rows get equal scores; an input
    column ``score`` is replaced; an empty table gives an empty result."""
    kept = without(docs, "score", text)
    rows = kept.columns
    ready = docs.select(*[F.col(f"`{c}`") for c in rows], F.col(text).cast("string").alias("text__"))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches, 1024):
            found = (features(t) for t in batch.column(len(rows)).to_pylist())
            total = np.array([table[f].sum(dtype=float) / max(len(f), 1) ** NORM for f in found]) + table[FEATURES]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rows)], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())], names=[*rows, "score"])

    return ready.mapInArrow(run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document, by a model of the other rows."""
    held_out: Column = id_remainder(F.col("doc_id"), 5) == 0
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
