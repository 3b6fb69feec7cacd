"""Benchmark decontamination by exact word windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lower_ascii, words_of, without

#: Anything but digits, lower-case letters and characters beyond ASCII parts two words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and the largest set of distinct windows that is broadcast.
SIZE, BROADCAST_WINDOWS = 10, 50_000


def item_words(text: Column) -> Column:
    return words_of(lower_ascii(text.cast("string")), SEPARATORS)


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct windows: ``length``, ``hash``, ``window`` (its words) and ``items`` (ids as text, sorted).

    An item of fewer words than ``size`` is one window of its own length; without words it has none. Items
    of one id are one item; a null id is the empty text."""
    worded = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.lit(size), F.size("words"))
    # the outer form: a plain explode adds a filter that would be pushed down and cut the windows again
    cut = worded.select("item", length.alias("length"), F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))).alias("window"))
    return cut.groupBy("length", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def scan(worded: DataFrame, key: list[str], windows: DataFrame) -> DataFrame:
    """One row per ``key``: ``n_words``, ``spans`` (place and length of each hit) and ``items``.

    A document is cut into blocks of b words; a window of 2b - 1 words or more contains a whole block, which
    starts at one of its first b places. So every block of every document is looked up among the blocks at
    those places of the windows, and the words of the window are then compared where it would lie. That
    finds each place where a window stands with a bth of the look-ups.

    The windows are broadcast where their counted number is within ``BROADCAST_WINDOWS``; a larger set is
    joined by a shuffle. A document's blocks are aggregated before they are shuffled."""
    sized = {r["length"]: r["count"] for r in windows.groupBy("length").count().collect()}  # at most SIZE rows
    small = sum(sized.values()) <= BROADCAST_WINDOWS
    parts = []
    for length in sorted(sized) or [SIZE]:
        block = (length + 1) // 2
        own = windows.where(F.col("length") == length).select("window", F.col("items").alias("found"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("offset"))
        own = own.select("window", "found", "offset", F.xxhash64(F.slice("window", F.col("offset") + 1, block)).alias("hash"))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(block)), lambda i: F.xxhash64(F.slice("words", i, block)))  # noqa: B023
        cut = worded.select(*key, "words", F.size("words").alias("n"), blocks.alias("blocks"))
        placed = cut.select(*key, "words", "n", F.posexplode_outer("blocks").alias("nth", "block"))
        start = F.col("nth") * block - F.col("offset")
        # membership in a one-element array: as an equality it would become a join key, worked out at every place
        same = F.array_contains(F.array("window"), F.slice("words", F.greatest(start, F.lit(0)) + 1, length)) & (start >= 0)
        joined = placed.join(F.broadcast(own) if small else own, (F.col("block") == F.col("hash")) & same, "left")
        span = F.when(F.col("hash").isNotNull(), F.struct(start.alias("place"), F.lit(length).alias("length")))
        parts.append(
            joined.groupBy(*key).agg(
                F.max("n").cast("long").alias("n_words"), F.collect_set(span).alias("spans"), F.flatten(F.collect_set("found")).alias("items")
            )
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    if len(parts) > 1:
        union = union.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return union.select(*key, "n_words", F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the spans, an array of (place, length) sorted by place: a running end."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["place"] + s["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["place"]))).alias("n"))

    return F.aggregate(spans, start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_hit``, ``n_items``, ``items``, ``spans`` and ``contaminated``.

    ``spans`` lists place and length of every hit window in words; ``items`` the benchmark items whose windows
    occur, sorted as text. Results meet the documents again by ``doc_id`` and a hash of the text, never by the
    text. A null text has no words; rows repeated with the same id and text get the same verdict each; null
    ids match null ids; input columns named like the results are replaced. An empty benchmark hits nothing."""
    docs = without(docs, "n_words", "n_hit", "n_items", "items", "spans", "contaminated", "words__", "key__", "id__", "hit_key__")
    keyed = docs.withColumn("key__", F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    worded = keyed.select(F.col("doc_id").alias("id__"), F.col("key__").alias("hit_key__"), item_words(F.col("text")).alias("words"))
    found = scan(worded, ["id__", "hit_key__"], benchmark_windows(benchmark, size))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("key__") == F.col("hit_key__")), "left").drop("id__", "hit_key__", "key__")
    return joined.withColumns({"n_hit": covered(F.col("spans")).cast("long"), "n_items": F.size("items").cast("long")}).withColumn("contaminated", F.col("n_hit") > 0)


def report(judged: DataFrame) -> DataFrame:
    """The digest columns of a judged table."""
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
