"""Merkle manifest of a dataset: a tree per group over its leaves, one tree over the groups, proofs of every leaf.

Only every ``STRIDE``-th level is written (a checkpoint). A proof needs the levels between as well: they are
worked out again inside each aligned subtree from its stored descendants, used for the siblings, and dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_remainder, let, lower_ascii, stored

#: Children of a node, and levels between two stored ones: an aligned subtree has ``FAN ** STRIDE`` descendants.
FAN, STRIDE = 8, 3
BLOCK = FAN**STRIDE
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def runs(nodes: Column) -> Column:
    """The parents of a list of digests: one digest for every run of ``FAN``, the last run may be shorter."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(starts, lambda k: F.sha2(F.array_join(F.slice(nodes, k * FAN + 1, FAN), ""), 256))


def grown(size: Column) -> Column:
    """Levels above the stored one that an aligned subtree spans: ``STRIDE``, or fewer where the tree ends."""
    levels, left = F.lit(0), size
    for _ in range(STRIDE):
        levels = levels + (left > 1).cast("int")
        left = F.ceil(left / FAN)
    return levels


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` written in order, plus ``pos`` (from 0) and ``size`` (rows) within their ``group``, nulls first.

    Rows are dealt into ranges of (group, order), so a group of any size is spread over tasks. A row's place is
    its place in its range plus what the ranges before hold of its group; only those counts meet in a window,
    one row per group and range. Equal rows are dealt apart by their place of reading and may swap numbers."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    spread = rows.withColumn("spread__", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("spread__"))
    dealt = stored(spread.sortWithinPartitions(*keys).drop("spread__").withColumn("seq__", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("range__", F.shiftright("seq__", 33))
    counts = dealt.groupBy(group, "range__").agg(F.count(F.lit(1)).alias("n__"), F.min("seq__").alias("first__"))
    whole = W.partitionBy(group)
    places = counts.select(
        F.col(group).alias("group__"), F.col("range__").alias("at__"), F.sum("n__").over(whole).alias("size"),
        (F.sum("n__").over(whole.orderBy("range__").rowsBetween(W.unboundedPreceding, 0)) - F.col("n__") - F.col("first__")).alias("shift__"),
    )
    joined = dealt.join(places, F.col(group).eqNullSafe(F.col("group__")) & (F.col("range__") == F.col("at__")))
    return joined.withColumn("pos", F.col("seq__") + F.col("shift__")).drop("seq__", "range__", "group__", "at__", "shift__")


def blocks(level: DataFrame, *more: str) -> DataFrame:
    """One row per aligned subtree of a stored level: ``nodes`` (its digests) and ``rows`` (with ``more``) in order."""
    kept = F.sort_array(F.collect_list(F.struct("pos", "digest", *more)))
    grouped = level.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("size").alias("size"), kept.alias("rows"))
    return grouped.withColumn("nodes", F.col("rows")["digest"])


def raised(level: DataFrame) -> DataFrame:
    """The next stored level of all trees that have more than one node."""
    up, left = F.col("nodes"), F.col("size")
    for _ in range(STRIDE):
        parents = runs(up)
        up = F.when(left > 1, parents).otherwise(up)
        left = F.ceil(left / FAN)
    above = blocks(level.where("size > 1")).select("tree", F.col("block").alias("pos"), up.alias("up"), left.cast("long").alias("size"))
    return above.select("tree", "pos", F.get("up", F.lit(0)).alias("digest"), "size")


def levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The stored levels of all trees, from ``leaves`` (``tree``, ``pos``, ``digest``, ``size``) up to their roots."""
    found, largest = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        found.append(stored(raised(found[-1]), f"{name}-{len(found)}"))
        largest = -(-largest // BLOCK)
    return found


def roots(found: list[DataFrame]) -> DataFrame:
    """``tree`` and ``root``: of each tree the level that has one node."""
    ends = [level.where("size = 1").select("tree", F.col("digest").alias("root")) for level in found]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def steps(nodes: Column, index: Column, count: Column) -> Column:
    """Siblings left and right of descendant ``index`` on each of the ``count`` levels of its aligned subtree."""

    def step(level: Column, at: Column) -> Column:
        first = (F.floor(at / FAN) * FAN).cast("int")
        run = F.slice(level, first + 1, FAN)
        own = (at - first).cast("int")
        return F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("left"), F.array_join(F.slice(run, own + 2, FAN), "").alias("right"))

    every = [step(F.get("inner", F.lit(k)) if k else nodes, F.floor(index / FAN**k)) for k in range(STRIDE)]
    return F.slice(F.array(*every), F.lit(1), count)


def proofs(found: list[DataFrame], above: DataFrame, *more: str) -> DataFrame:
    """``tree``, ``digest``, ``more``, ``path`` and ``about`` of every leaf.

    ``above`` has, for each tree, the path of its root and ``about``, which goes down with it.

    Stored levels are walked from the top: an aligned subtree joins the path of its root, works out its inner
    levels from its stored descendants, and hands each of them its siblings in front of that path."""
    paths = above.select(F.col("tree").alias("tree__"), F.lit(0).cast("long").alias("at__"), F.col("path").alias("above__"), "about")
    for k in range(len(found) - 1, -1, -1):
        own, carried = found[k], more if k == 0 else ()
        # a tree's single node is its root: its path is the one above
        alone = own.where("size = 1").join(paths, F.col("tree").eqNullSafe(F.col("tree__"))).select("tree", "digest", *carried, F.col("pos"), F.col("above__").alias("path"), "about")
        wide = blocks(own.where("size > 1"), *carried).withColumn("levels__", grown(F.col("size")))
        joined = wide.join(paths, F.col("tree").eqNullSafe(F.col("tree__")) & (F.col("block") == F.col("at__")))
        # levels between: index 0 stands for the stored nodes themselves
        inner = let(runs(F.col("nodes")), lambda one: F.array(F.array().cast("array<string>"), one, runs(one)))
        each = joined.withColumn("inner", inner).select("*", F.posexplode("rows").alias("i__", "row__"))
        path = F.concat(steps(F.col("nodes"), F.col("i__"), F.col("levels__")), F.col("above__"))
        spread = each.select("tree", F.col("row__.digest").alias("digest"), *[F.col(f"row__.{c}").alias(c) for c in carried], F.col("row__.pos").alias("pos"), path.alias("path"), "about")
        out = spread.unionByName(alone)
        if k:
            # roots of smaller trees have their path already and go down beside the others
            paths = paths.join(roots(found[k:]).select(F.col("tree").alias("done__")), F.col("tree__").eqNullSafe(F.col("done__")), "left_anti")
            paths = stored(paths.unionByName(out.select(F.col("tree").alias("tree__"), F.col("pos").alias("at__"), F.col("path").alias("above__"), "about")), f"paths-{k}")
    return out


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, tampered: Column | None = None, group: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``path`` (siblings by level) and ``folded_root`` of every row.

    ``tampered`` is a text to verify in place of the row's own; leaf and path stay those of ``docs``. Leaves ascend
    by ``doc_id`` within their group, null ids first, rows of one id by their leaf; rows equal in all fields may
    swap places, which changes their paths alone. A null group comes first of all groups. An empty table gives an
    empty result. Columns outside ``fields`` take no part.

    Texts become digests in the scan and are never shuffled. A group with most of the rows is dealt into ranges and
    aligned subtrees of 512 leaves, so no task holds more than that of a tree."""
    columns = [F.col(c) for c in fields]
    other = columns if tampered is None else [tampered if c == "text" else F.col(c) for c in fields]
    leaves = docs.select(F.col(group).cast("string").alias("tree"), F.col("doc_id"), leaf_digest(columns).alias("digest"), leaf_digest(other).alias("checked"))
    found = levels(numbered(leaves, "tree", ["doc_id", "digest"], "leaves"), "level")
    subroots = roots(found).select(F.lit("").alias("tree"), F.col("tree").alias("member"), F.col("root").alias("digest"))
    top = levels(numbered(subroots, "tree", ["member"], "subroots"), "top")
    start = roots(top).select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("root").alias("about"))
    about = F.struct(F.col("digest").alias("subroot"), F.col("about").alias("root")).alias("about")
    upper = stored(proofs(top, start, "member").select(F.col("member").alias("tree"), "path", about), "groups")
    return proofs(found, upper, "doc_id", "checked").select(
        "doc_id", F.col("digest").alias("leaf"), "about.subroot", "about.root", "path", folded(F.col("checked"), F.col("path")).alias("folded_root")
    )


def verified(docs: DataFrame) -> DataFrame:
    """The manifest's digests of ``docs``, each row verified against a copy in which some texts are lower-cased.

    A text is altered where 3 divides the crc32 of the decimal id (a null id counts as empty text)."""
    altered = F.when(id_remainder(F.col("doc_id"), 3) == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proof = F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256")
    return manifest(docs, altered).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
