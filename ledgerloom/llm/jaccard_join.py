"""Similarity join of documents on word shingles, by count vectors in R-trees.

Shingles are hashed to groups; a document is the point of its group counts. The overlap of two sets is at most
the sum of the smaller counts, so an R-tree over points, whose boxes carry the largest counts below them, leaves
out whole subtrees that cannot reach the needed overlap.

One tree cannot span a cluster, and random group counts of all texts lie close together. So trees are built per
block: documents that share a shingle of their prefixes. Under one total order of shingles, rare ones first, two
sets of similarity t share one within their first n - ceil(t n) + 1; any order is right, the count sketch that
gives it only keeps blocks small. Most links come from comparing each document with the first of its blocks;
trees then search the blocks that still hold several components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import among, slices, stored, without
from ledgerloom.llm.quality_model import rows_of

#: Words of a shingle, similarity in hundredths, groups of a count vector.
WORDS, PERCENT, GROUPS = 5, 80, 256
#: Leaf and node size of a tree; points that one tree holds, larger blocks are joined in parts.
FANOUT, TREE_POINTS = 32, 2_000
#: Cells of the count sketch: near the number of documents, within these bounds.
SKETCH_CELLS = (1 << 16, 1 << 22)


#: Capital ASCII letters made small, byte by byte: bytes of other characters are never ASCII.
SMALL = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: Which bytes part words: the blank and the five control white spaces.
BLANK = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Base of the polynomial hash of a word's bytes.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two runs of words, in their order."""
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a whole text, all worked out together: a polynomial of its bytes, mixed with its length."""
    # a lone surrogate, which Arrow never delivers, would not encode
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(SMALL), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[data], [True]]).astype(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    letters = data[~BLANK[data]].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    letters *= powers[np.arange(len(letters)) - np.repeat(first, lengths)]
    return mixed(np.add.reduceat(letters, first), lengths.astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of five neighbouring words of a whole text; of the whole sequence where there are fewer.

    Runs are built from shorter runs: two, four, five words. A null text and one without words have none."""
    one = word_hashes(text)
    if len(one) < WORDS:
        whole = one[:1]
        for k in range(1, len(one)):
            whole = mixed(whole, one[k : k + 1])
        return mixed(whole, np.full(len(whole), len(one), np.uint64)).view(np.int64)
    two = mixed(one[:-1], one[1:])
    four = mixed(two[:-2], two[2:])
    return np.unique(mixed(four[:-1], one[4:]).view(np.int64))


def shingle_lists(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``shingles`` of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def cells_of(values: np.ndarray, cells: int) -> np.ndarray:
    return ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % cells


def count_sketch(docs: DataFrame, cells: int) -> np.ndarray:
    """How many documents have a shingle of each cell, over all documents: a fixed size, summed in blocks."""
    block = 1 << 14

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in slices(batches):
            values = np.concatenate([*(shingles(t) for t in batch.column(0).to_pylist()), np.zeros(0, np.int64)])
            np.add.at(total, cells_of(values, cells), 1)
        parts = [total[i : i + block] for i in range(0, cells, block)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype("<u4").tobytes() for p in parts])], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<u4").astype(np.int64) for b in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()])})

    parts = docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    return np.concatenate([np.frombuffer(bytes(r["counts"]), "<u4") for r in sorted(parts, key=lambda r: r["part"])] or [np.zeros(cells, np.uint32)])


def points(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``doc_id``, ``n``, two hashes of the set, ``counts`` (the point) and ``prefix`` (rare shingles first)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for own in map(shingles, batch.column(1).to_pylist()):
                unsigned, n = own.view(np.uint64), len(own)
                keys = own[np.lexsort((own, shared.value[cells_of(own, len(shared.value))]))][: n - (n * PERCENT + 99) // 100 + 1] if n else own
                first = int(np.bitwise_xor.reduce(unsigned * np.uint64(0xBF58476D1CE4E5B9))) if n else 0
                second = int(np.add.reduce((unsigned ^ (unsigned >> np.uint64(31))) * np.uint64(0x94D049BB133111EB))) if n else 0
                counts = np.bincount((unsigned >> np.uint64(7)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS)
                counts = counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()
                rows.append((n, first - (1 << 63), second - (1 << 63), counts, keys))
            n, first, second, counts, keys = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(counts, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "first", "second", "counts", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(place, "doc_id long, n long, first long, second long, counts binary, prefix array<long>")


def vector(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, "u1" if len(counts) == GROUPS else "<u4").astype(np.int32)


def vectors(counts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """All points of a column at once; those of equal width are one buffer."""
    column = counts.combine_chunks() if isinstance(counts, pa.ChunkedArray) else counts
    cuts = np.frombuffer(column.buffers()[1], "<i4", count=len(column) + 1 + column.offset)[column.offset :]
    if len(column) and (np.diff(cuts) == GROUPS).all():
        return np.frombuffer(column.buffers()[2], "u1")[cuts[0] : cuts[-1]].reshape(-1, GROUPS)
    return np.stack([vector(c) for c in column.to_pylist()])


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of two linked sets of n and m shingles: 100 i >= p (n + m - i)."""
    return -(-(PERCENT * (n + m)) // (100 + PERCENT))


class Tree:
    """An R-tree packed by size and by the heaviest groups: each box has the largest counts and sizes below it."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, components: np.ndarray | None = None):
        heavy = np.argsort(-counts.var(axis=0), kind="stable")[:2]
        self.order = np.lexsort((counts[:, heavy[1]], counts[:, heavy[0]], np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.25))))
        own = np.arange(len(sizes)) if components is None else components
        # points of one component lie together where size and heavy groups allow it; a box knows its first and last
        self.order = self.order[np.lexsort((np.arange(len(own)), own[self.order], np.arange(len(own)) // (FANOUT * FANOUT)))]
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order], own[self.order], own[self.order])]
        while len(self.levels[-1][0]) > 1:
            high, low_n, high_n, low_c, high_c = self.levels[-1]
            cuts = np.arange(0, len(high), FANOUT)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(low_n, cuts), np.maximum.reduceat(high_n, cuts), np.minimum.reduceat(low_c, cuts), np.maximum.reduceat(high_c, cuts)))
        self.named = components is not None

    def join(self, other: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Places of the points of both trees whose bound reaches the needed overlap."""
        top = max(len(self.levels), len(other.levels)) - 1
        mine, yours = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(top, -1, -1):
            if level < top:
                mine, yours = expand(mine, yours, len(self.at(level)[0]), len(other.at(level)[0]), level < len(self.levels) - 1, level < len(other.levels) - 1)
            kept = [self.reach(other, level, mine[i : i + 8192], yours[i : i + 8192]) for i in range(0, len(mine), 8192)]
            keep = np.concatenate(kept) if kept else np.zeros(0, bool)
            mine, yours = mine[keep], yours[keep]
        return self.order[mine], other.order[yours]

    def at(self, level: int):
        return self.levels[min(level, len(self.levels) - 1)]

    def reach(self, other: Tree, level: int, mine: np.ndarray, yours: np.ndarray) -> np.ndarray:
        (a, a_low, a_high, a_first, a_last), (b, b_low, b_high, b_first, b_last) = self.at(level), other.at(level)
        sized = (100 * a_high[mine] >= PERCENT * b_low[yours]) & (100 * b_high[yours] >= PERCENT * a_low[mine])
        if self.named:
            # boxes that hold one and the same component have no pair to find
            sized &= (a_first[mine] != a_last[mine]) | (b_first[yours] != b_last[yours]) | (a_first[mine] != b_first[yours])
        sized[sized] = np.minimum(a[mine[sized]], b[yours[sized]]).sum(axis=1, dtype=np.int64) >= needed(a_low[mine[sized]], b_low[yours[sized]])
        return sized


def expand(mine: np.ndarray, yours: np.ndarray, n: int, m: int, grow_mine: bool, grow_yours: bool):
    """All pairs of children of the given pairs of nodes."""
    a = (mine[:, None] * FANOUT + np.arange(FANOUT)) if grow_mine else mine[:, None]
    b = (yours[:, None] * FANOUT + np.arange(FANOUT)) if grow_yours else yours[:, None]
    left, right = np.broadcast_arrays(a[:, :, None], b[:, None, :])
    left, right = left.ravel(), right.ravel()
    real = (left < n) & (right < m)
    return left[real], right[real]


def join_block(table: pa.Table) -> pa.Table:
    """Pairs of different components in one block, or between two parts of it, that pass the bound."""
    ids, parts, components, sizes = (table.column(c).to_numpy() for c in ("node", "part", "component", "n"))
    counts = vectors(table.column("counts"))
    low, high = parts == parts.min(), parts == parts.max()
    left, right = np.flatnonzero(low), np.flatnonzero(high)
    first = Tree(counts[left], sizes[left], components[left])
    # a part meets itself, or another one
    a, b = first.join(first if parts.min() == parts.max() else Tree(counts[right], sizes[right], components[right]))
    a, b = left[a], right[b]
    keep = components[a] != components[b]
    pairs = np.unique(np.stack([np.minimum(ids[a], ids[b])[keep], np.maximum(ids[a], ids[b])[keep]]), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose count vectors allow the needed overlap."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.col("n_a") >= PERCENT * F.col("n_b")) & (100 * F.col("n_b") >= PERCENT * F.col("n_a")))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            n = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)])
            sums = np.minimum(vectors(batch.column(4)), vectors(batch.column(5))).sum(axis=1, dtype=np.int64)
            keep = pa.array(sums >= needed(n[0], n[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return sized.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets truly reach the similarity, by an exact intersection."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = shingle_lists(among(docs.select("doc_id", "text"), ids))
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            (x, x_cuts), (y, y_cuts) = rows_of(batch, "set_a"), rows_of(batch, "set_b")
            keep = []
            for i in range(batch.num_rows):
                a, b = x[x_cuts[i] : x_cuts[i + 1]], y[y_cuts[i] : y_cuts[i + 1]]
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the links.

    Each round takes the smallest component among a node and its neighbours, then that component's own; each
    is written to the shared folder. Rounds grow with the logarithm of a chain, and end when nothing changes."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        rows = stored(moved.join(jump, "component", "left").select("node", "old", F.least("component", "further").alias("component")), "labels")
        labels = rows.select("node", "component")
        if rows.where("old <> component").isEmpty():
            return labels


def residual_pairs(keys: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that pass the bound, from every block that holds more than one component.

    Blocks of the same members are searched once. A block is one tree up to ``TREE_POINTS``; a larger one is
    dealt into parts, and each pair of parts is a task of its own."""
    labelled = keys.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    blocks = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("xor"))
    blocks = blocks.where("lo <> hi").groupBy("m", "sum", "xor").agg(F.min("key").alias("key"))
    blocks = blocks.select("key", F.ceil(F.col("m") / TREE_POINTS).cast("long").alias("parts"))
    members = labelled.join(blocks, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # part i meets each part j: as the smaller of (i, j) or the larger
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    members = members.join(nodes.select("node", "n", "counts"), "node")
    grouped = members.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "component", "n", "counts")
    return grouped.groupBy("key", "i", "j").applyInArrow(join_block, "a long, b long").distinct()


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``; other columns play no part.

    Two documents link where their shingle sets have a Jaccard similarity of 0.8 or more; a component is what
    links reach, named by its smallest ``doc_id``. Equal sets are one node from the start, so copies are never
    paired. Null texts and texts without words have no shingles and stand alone. A row without ``doc_id`` is
    judged too but gives no name; alone it has none. Rows of one ``doc_id`` are judged by their own texts."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cells = 1 << max(0, base.count() - 1).bit_length()
    sketch = count_sketch(base, min(max(cells, SKETCH_CELLS[0]), SKETCH_CELLS[1]))
    placed = stored(points(base, sketch), "points")
    classes = placed.where("n > 0").groupBy("n", "first", "second").agg(F.min("doc_id").alias("node"))
    classes = stored(classes, "classes")
    chosen = placed.join(classes.where(F.col("node").isNotNull()).withColumnRenamed("node", "doc_id"), ["n", "first", "second", "doc_id"], "left_semi").dropDuplicates(["doc_id", "n", "first", "second"])
    nodes = chosen.select(F.col("doc_id").alias("node"), "n", "counts")
    keys = chosen.select(F.explode("prefix").alias("key"), F.col("doc_id").alias("node")).where(F.col("node").isNotNull())
    leaders = keys.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "a")
    shared = stored(keys.join(leaders, "key"), "shared-keys")
    stars = shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = stored(verified(stored(bounded(stars, nodes), "pairs"), base), "links")
    labels = components(links)
    rest = stored(residual_pairs(shared.select("key", "node"), nodes, labels).join(links, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = stored(verified(rest, base), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    named = classes.join(labels, "node", "left").select("n", "first", "second", F.coalesce("component", "node").alias("component"))
    joined = placed.join(named, ["n", "first", "second"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the smallest ``doc_id``; documents without words all stay.

    Rows without ``doc_id`` stay. All columns keep their values; a row repeated with its id stays repeated."""
    docs = without(docs, "kept__")
    kept = jaccard_join(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept__")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long") == F.col("kept__"), "left").where(F.col("kept__").isNotNull() | F.col("doc_id").isNull()).drop("kept__")
