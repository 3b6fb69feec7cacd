"""Quality scores: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerloom.llm.common import id_remainder, let, slices, without, words_of

#: Hash space of the n-grams, labelled rows that train at most, shards whose weights are averaged.
DIMENSIONS, TRAIN_ROWS, SHARDS = 1 << 18, 16_384, 4
#: Step, smoothing and penalties of the updates, and passes over a shard.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.02, 0.1, 3


def bucket(value: Column) -> Column:
    return F.pmod(value, F.lit(DIMENSIONS)).cast("int")


def grams(words: Column, view: str) -> Column:
    """Hashed words and word pairs of one view."""
    single = F.transform(words, lambda w: F.xxhash64(F.lit(view), w))
    return let(single, lambda h: F.transform(F.concat(h, F.zip_with(h, F.slice(h, 2, 1 << 30), lambda a, b: F.xxhash64(a, b))), bucket))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``grams`` (hashed n-grams of words and of word shapes) and ``traits`` (hashed grades).

    A shape replaces runs of small letters, capitals and digits by one character each, so unseen words still
    share n-grams. Traits grade the share of distinct word pairs and the number of words: also words, of a view of their own.
    A null text counts as empty and has traits only."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\d+", "0")
    ready = docs.withColumns({"words__": words_of(whole), "shapes__": words_of(shape)})
    pairs = lambda h: F.zip_with(h, F.slice(h, 2, 1 << 30), lambda a, b: F.xxhash64(a, b))
    share = let(pairs(F.col("words__")), lambda p: F.floor(20 * F.size(F.array_distinct(p)) / F.greatest(F.size(p), F.lit(1))))
    size = F.floor(F.log2(F.size("words__") + F.lit(1.0)))
    return ready.withColumns(
        {
            "grams": F.concat(grams(F.transform("words__", lambda w: F.lower(w)), "word"), grams(F.col("shapes__"), "shape")),
            "traits": F.transform(F.array(F.xxhash64(F.lit("share"), share), F.xxhash64(F.lit("size"), size)), bucket),
        }
    ).drop("words__", "shapes__")


def rows_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row cuts of a list column, whatever slice the batch is."""
    column = batch.column(batch.schema.get_field_index(name))
    cuts = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]], cuts - cuts[0]


def examples(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each row: n-grams weigh 1 / sqrt(n) an occurrence, traits 1."""
    gram, gram_cuts = rows_of(batch, "grams")
    trait, trait_cuts = rows_of(batch, "traits")
    for i in range(batch.num_rows):
        g, t = gram[gram_cuts[i] : gram_cuts[i + 1]], trait[trait_cuts[i] : trait_cuts[i + 1]]
        index, count = np.unique(g, return_counts=True)
        yield np.concatenate([index, t]), np.concatenate([count / np.sqrt(max(len(g), 1)), np.ones(len(t))])


class Leader:
    """Follow-the-regularised-leader: weights come from sums of gradients, most stay exactly zero."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        weights = self.weights(index)
        gradient = (1 / (1 + np.exp(-np.clip(weights @ value, -35, 35))) - label) * value
        grown = self.n[index] + gradient * gradient
        np.add.at(self.z, index, gradient - (np.sqrt(grown) - np.sqrt(self.n[index])) / ALPHA * weights)
        np.add.at(self.n, index, gradient * gradient)


def train(docs: DataFrame, labels: DataFrame, divisor: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from labelled rows whose id remainder is not ``held_out``; at most about ``rows`` of them.

    The bound is for the fit alone: rows are taken by a hash of the id, whatever the table's size. An id with
    several labels counts by its larger one; null ids and labels teach nothing. Each of ``SHARDS`` groups
    follows its own leader over its rows in the order of a hash, and the weights are averaged."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), divisor) != held_out))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label__"))
    every = max(1, -(-known.count() // rows))
    # the hash keeps one id in ``every``: a known number of small rows, safe to broadcast
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    rows_used = features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("doc_id", "label__", "grams", "traits")

    def fit(table: pa.Table) -> pa.Table:
        leader, held = Leader(), []
        for batch in table.sort_by([("place", "ascending"), ("copy", "ascending")]).combine_chunks().to_batches():
            held.extend((label, index.astype(np.int32), value.astype(np.float32)) for label, (index, value) in zip(batch.column("label__").to_pylist(), examples(batch), strict=True))
        for _ in range(PASSES):
            for label, index, value in held:
                leader.learn(index, value.astype(float), label)
        learnt = leader.weights().astype(np.float32)
        index = np.flatnonzero(learnt)
        # a shard is counted by an index of its own, as one without any weight counts too
        return pa.table({"index": np.append(index, DIMENSIONS).astype(np.int32), "weight": np.append(learnt[index], 1).astype(np.float64)})

    # the shard is a column: the same rows meet the same leader however Spark deals them
    shard, place, copy = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)), F.xxhash64(F.col("doc_id"), F.lit(7)), F.xxhash64("grams")
    shards = rows_used.select(shard.alias("shard"), place.alias("place"), copy.alias("copy"), "label__", "grams", "traits").groupBy("shard")
    # summed by Spark: the driver gets one number per index at most, however many shards there are
    summed = shards.applyInArrow(fit, "index int, weight double").groupBy("index").agg(F.sum("weight").alias("weight")).toArrow()
    sums = np.zeros(DIMENSIONS + 1)
    sums[summed.column("index").to_numpy()] = summed.column("weight").to_numpy()
    return sums[:DIMENSIONS] / max(sums[DIMENSIONS], 1)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``score`` from 0 to 1: one sparse dot product per whole text.

    Every row is scored, empty and null texts too; repeated rows get equal scores; an input column ``score``
    is replaced."""
    kept = without(docs, "score", "grams", "traits", "words__", "shapes__", text).columns
    ready = features(docs, text).select(*kept, "grams", "traits")
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4"))
    names = [*kept, "score"]

    def dots(values: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0.0], np.cumsum(table[values], dtype=float)])
        return running[cuts[1:]] - running[cuts[:-1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            gram, cuts = rows_of(batch, "grams")
            total = dots(gram, cuts, shared.value) / np.sqrt(np.maximum(np.diff(cuts), 1)) + dots(*rows_of(batch, "traits"), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=names)

    return ready.mapInArrow(run, StructType([*ready.schema.fields[: len(kept)], StructField("score", DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document, by a model of the other rows."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
