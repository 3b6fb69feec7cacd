"""Repair of conversation structure: faults of every row, and the cheapest edits that restore the order of roles.

Roles must read ``(s?(ua)+)?`` by their initials. The edits of a stretch of rows are found by a depth-first
branch-and-bound with an explicit stack: bounds from below for every suffix, an incumbent of cost and audit, and a
table of the best prefix at every node, until no open prefix can beat the incumbent."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.common import stored

#: Costs of the edits, and what a truncated row adds where it is not deleted.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. What a row's initial leads to; what a new row leads to.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEW = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
#: Rows numbered alike that one search takes at most: longer conversations are solved in stretches and joined exactly.
STRETCH = 128
LEGAL = {"su", "ua", "au"}
HARD = float("inf")


class Bounds:
    """Costs that every repair of a suffix must pay at least.

    A code is ``D`` for a row that must go, else the role's initial (``o`` for any other role), a capital where
    the row is truncated. Each row pays its cheapest edit. Beside that, neighbours that may not follow each other
    pay for an insertion, another role or a deletion; as one edit can mend two such pairs, pairs without a common
    row are chosen so that they pay most."""

    def __init__(self, codes: str, exits: tuple[int, ...]):
        self.codes, self.exits, n = codes, exits, len(codes)
        self.last = [self.inserted(s) for s in range(4)]
        self.base, self.at, kept = [0] * (n + 1), [0] * (n + 1), []
        for i in range(n - 1, -1, -1):
            code = codes[i]
            least = DELETE if code in "DO" else RENAME if code == "o" else TRUNCATED if code.isupper() else 0
            self.base[i] = self.base[i + 1] + least
            if code != "D":
                kept.append(code)
            self.at[i] = len(kept)
        # pairs[m]: what pairs among the last m kept rows and the end pay; rows are stored from the last one
        self.kept, self.pairs = kept, [0, 0]
        for m, code in enumerate(kept):
            behind = self.ending(code) if m == 0 else self.pair(code, kept[m - 1])
            self.pairs.append(max(self.pairs[-1], behind + self.pairs[-2]))

    def inserted(self, state: int) -> float:
        for count in range(3):
            if state in self.exits:
                return count * INSERT
            state = NEW[state]
        return HARD

    def weight(self, *codes: str) -> int:
        return DELETE - TRUNCATED if any(c.isupper() for c in codes) else min(RENAME, INSERT, DELETE)

    def pair(self, one: str, two: str) -> int:
        wrong = "o" not in (one + two).lower() and (one + two).lower() not in LEGAL
        return self.weight(one, two) if wrong else 0

    def ending(self, code: str) -> int:
        return 0 if code in "oO" or "sua".index(code.lower()) + 1 in self.exits else self.weight(code)

    def rest(self, i: int, state: int) -> float:
        """Least cost from row ``i`` in ``state``; infinite where no exit can be reached."""
        if not any(e == state or e > 1 or (e == 1 and state == 0) for e in self.exits):
            return HARD
        m = self.at[i]
        if not m:
            return self.base[i] + self.last[state]
        code = self.kept[m - 1]
        wrong = code not in "oO" and (state, code.lower()) not in AFTER
        return self.base[i] + max(self.pairs[m + 1], self.weight(code) + self.pairs[m] if wrong else 0)


def edits(codes: str, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits at a node in ASCII order: letter, next row, next state, cost."""
    code = codes[i] if i < len(codes) else ""
    extra = TRUNCATED if code.isupper() else 0
    if code:
        yield "D", i + 1, state, DELETE
    yield "I", i, NEW[state], INSERT
    if code and code != "D":
        if (state, code.lower()) in AFTER:
            yield "K", i + 1, AFTER[state, code.lower()], extra
        yield "R", i + 1, NEW[state], RENAME + extra


def dive(codes: str, entry: int, bounds: Bounds) -> tuple[float, str]:
    """A first incumbent: the child with the least bound at each step."""
    i, state, cost, audit = 0, entry, 0, ""
    while i < len(codes) or state not in bounds.exits:
        options = [(cost + price + bounds.rest(k, s), letter, k, s, price) for letter, k, s, price in edits(codes, i, state) if letter != "I" or not audit.endswith("II")]
        bound, letter, i, state, price = min(options, default=(HARD, "", 0, 0, 0))
        if bound == HARD:
            return HARD, ""
        cost, audit = cost + price, audit + letter
    return cost, audit


@lru_cache(maxsize=1 << 15)
def solve(codes: str, entry: int = 0, exits: tuple[int, ...] = ENDS) -> tuple[float, str]:
    """Least cost and, among equal costs, least audit of edits that lead from ``entry`` to one of ``exits``.

    Children are opened in ASCII order, so of two prefixes that cost the same at a node the earlier one is the
    lesser. Two prefixes of one node and cost are never one the beginning of the other, as edits that return to
    a node cost something: the lesser prefix gives the lesser audit."""
    bounds = Bounds(codes, exits)
    best, tables, stack = dive(codes, entry, bounds), {}, [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + bounds.rest(i, state)
        if bound == HARD or bound > best[0] or (bound == best[0] and audit > best[1][: len(audit)]):
            continue
        if tables.get((i, state), (HARD,)) <= (cost, audit):
            continue
        tables[i, state] = (cost, audit)
        if i == len(codes) and state in exits:
            best = min(best, (cost, audit))
            continue
        stack.extend([(k, s, cost + price, audit + letter) for letter, k, s, price in edits(codes, i, state)][::-1])
    return best


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of ``conv_id:turn`` modulo 20; nulls in role, text and key count as one blank.

    0 marks the row ``dropped``, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's.
    ``tie`` (a digest of the row as it was) and ``copy`` order rows of one turn."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text, role = blank("text"), blank("role")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.md5(F.concat_ws(":", F.length(role), role, text)).alias("tie"), (kind == 0).alias("dropped"),
        F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.withColumn("copy", F.explode("copies")).drop("copies")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns that order and mark them, where they have none of their own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    ready = rows.withColumns({"role": role, "text": text, "turn": F.col("turn").cast("long")})
    given = {"tie": F.md5(F.concat_ws(":", F.length(role), role, text)), "copy": F.lit(0), "dropped": F.lit(False)}
    absent = {c: v for c, v in given.items() if c not in rows.columns}
    return (ready.withColumns(absent) if absent else ready).select("conv_id", "turn", "role", "text", *given)


def keys(*before: str) -> list:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", *before, "turn", "tie", "copy")]


def marked(rows: DataFrame) -> DataFrame:
    """One small row per row of ``ordered``: ``seq`` in the order of conversations, ``initial`` and ``kind``.

    ``kind`` is null for a dropped row, else ``b`` blank, ``d`` duplicate, ``t`` truncated or ``k``. Rows are dealt
    into ranges without their texts, so a conversation of any length is spread. A text seen earlier is found by
    the least ``seq`` of its digest, summed up before the shuffle."""
    mark = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    last = F.when(mark == "", "b").when(mark.isin(".", "!", "?"), "k").otherwise("t")
    first = F.substring("role", 1, 1)
    small = rows.select(
        "conv_id", "turn", "tie", "copy", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
        F.when(~F.col("dropped"), last).alias("kind"),
        F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("spread__"),
    )
    dealt = small.repartitionByRange(*keys(), F.col("spread__")).sortWithinPartitions(*keys())
    light = stored(dealt.select("conv_id", "turn", "initial", "kind", "digest", F.monotonically_increasing_id().alias("seq")), "turns")
    seen = light.where("kind <> 'b'").groupBy("conv_id", "digest").agg(F.min("seq").alias("first__"), F.count(F.lit(1)).alias("n__")).where("n__ > 1")
    seen = seen.select(F.col("conv_id").alias("conv__"), F.col("digest").alias("digest__"), "first__")
    joined = light.join(seen, F.col("conv_id").eqNullSafe(F.col("conv__")) & (F.col("digest") == F.col("digest__")), "left")
    kind = F.when(F.col("kind").isNotNull() & (F.col("kind") != "b") & (F.col("seq") > F.col("first__")), "d").otherwise(F.col("kind"))
    return joined.select("conv_id", "turn", "initial", kind.alias("kind"), "seq")


MOVES = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
COUNTS = "blank long, duplicate long, truncated long, illegal long"


def stretches(light: DataFrame) -> DataFrame:
    """At most ``STRETCH`` rows of one conversation in a row: their counts, their ends and their cheapest edits.

    A stretch that may go on before or behind has the edits between any two states, else those of a whole
    conversation."""
    ends = light.groupBy(F.shiftright("seq", 33).alias("range__")).agg(F.max("seq").alias("end__"))
    row = F.struct("seq", "turn", "initial", "kind")
    parts = light.groupBy("conv_id", F.floor(F.col("seq") / STRETCH).alias("stretch")).agg(F.min("seq").alias("seq"), F.max("seq").alias("to__"), F.sort_array(F.collect_list(row)).alias("rows"))
    joined = parts.join(ends, F.shiftright("seq", 33) == F.col("range__"))
    is_open = (F.col("seq") % STRETCH == 0) | (F.col("to__") % STRETCH == STRETCH - 1) | (F.col("to__") == F.col("end__"))
    kept = F.filter("rows", lambda r: r["kind"].isNotNull())
    ready = joined.select(
        "conv_id", "seq", is_open.alias("open"), kept["turn"].alias("turns"),
        F.array_join(kept["initial"], "").alias("initials"), F.array_join(kept["kind"], "").alias("kinds"),
    )
    names = ["conv_id", "seq", "blank", "duplicate", "truncated", "illegal", "initials", "turns", "moves"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for whole, turns, initials, marks in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                codes = "".join("D" if k in "bd" else i.upper() if k == "t" else i for i, k in zip(initials, marks, strict=True))
                wanted = [(a, (b,)) for a in range(4) for b in range(4)] if whole else [(0, ENDS)]
                found = [(a, b, *solve(codes, a, b)) for a, b in wanted]
                moves = [{"entry": a, "exit": b[-1], "cost": int(c), "audit": audit} for a, b, c, audit in found if c < HARD]
                known = [t for t in turns if t is not None]
                pairs = sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))
                out.append((marks.count("b"), marks.count("d"), marks.count("t"), pairs, initials[:1] + initials[-1:], [known[0], known[-1], len(set(known))] if known else [], moves))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    schema = StructType([*ready.schema.fields[:2], *StructType.fromDDL(f"{COUNTS}, initials string, turns array<long>, moves {MOVES}").fields])
    return ready.mapInArrow(search, schema)


def joined_moves(held: dict, moves: list[dict]) -> dict:
    """Best cost and audit by state after one more stretch."""
    after = {}
    for m in moves:
        if m["entry"] in held:
            cost, audit = held[m["entry"]]
            found = (cost + m["cost"], audit + m["audit"])
            after[m["exit"]] = min(after.get(m["exit"], found), found)
    return after


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation: its counts, least cost and audit.

    The stretches of a conversation come in order and are joined state by state; what the audits of all states
    have in common is put aside, so a long conversation holds short ends only."""
    parts = stretches(marked(rows))
    dealt = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, last, span, held, done = None, [0] * 4, "", [], {}, []

        def result() -> tuple:
            cost, audit = min(held[s] for s in ENDS if s in held)
            gaps = span[1] - span[0] + 1 - span[2] if span else 0
            return (gaps, *sums, cost, "".join(done) + audit)

        def batch_of(ids: list[pa.Array], out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 6 + [pa.string()], strict=True)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names=["conv_id", *names])

        key = None
        for batch in batches:
            ids, out, convs = [], [], batch.column(0).to_pylist()
            for k, row in enumerate(batch.to_pylist()):
                if key is None or convs[k] != own:
                    if key is not None:
                        ids.append(key)
                        out.append(result())
                    own, key = convs[k], batch.column(0).slice(k, 1)
                    sums, last, span, held, done = [0] * 4, "", [], {0: (0, "")}, []
                sums = [a + row[c] for a, c in zip(sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
                if row["initials"]:
                    sums[3] += bool(last) and last + row["initials"][0] not in LEGAL
                    last = row["initials"][-1]
                if row["turns"]:
                    first, end, n = row["turns"]
                    span = [span[0], end, span[2] + n - (first == span[1])] if span else [first, end, n]
                held = joined_moves(held, row["moves"])
                if max(len(audit) for _, audit in held.values()) > 1 << 14:
                    same = os.path.commonprefix([audit for _, audit in held.values()])
                    done.append(same)
                    held = {s: (cost, audit[len(same) :]) for s, (cost, audit) in held.items()}
            if out:
                yield batch_of(ids, out)
        if key is not None:
            yield batch_of([key], [result()])

    fields = StructType.fromDDL(f"gaps long, {COUNTS}, cost long, audit string").fields
    return dealt.mapInArrow(follow, StructType([parts.schema["conv_id"], *fields]))


class Edited:
    """The repaired rows of one conversation, from its audit and its rows in order."""

    def __init__(self, audit: str):
        self.letters, self.state = iter(audit), 0

    def inserts(self) -> Iterator[tuple[str, str]]:
        """New rows up to the next letter that takes a row, which stays in ``letter``."""
        for self.letter in self.letters:
            if self.letter != "I":
                return
            self.state = NEW[self.state]
            yield ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        if self.letter == "K":
            self.state = AFTER[self.state, role[:1]]
            yield role, text
        elif self.letter == "R":
            self.state = NEW[self.state]
            yield ROLE[self.state], text


def lined_up(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan and, behind it, its rows in order: its texts are shuffled once, here."""
    heads = planned.select("conv_id", F.struct(*[c for c in planned.columns if c != "conv_id"]).alias("plan"))
    both = rows.where(~F.col("dropped")).drop("dropped").unionByName(heads, allowMissingColumns=True).withColumn("body", F.col("plan").isNull())
    return both.repartition("conv_id").sortWithinPartitions(*keys("body")).select("conv_id", "plan", "role", "text")


def repair_digests(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and the digest of the repaired ``role:text`` lines of every conversation.

    ``rows`` have ``conv_id``, ``turn``, ``role`` and ``text``, and may have ``tie`` and ``copy`` (order within a turn,
    else a digest of role and text) and ``dropped`` (the row only names its conversation). Null roles and texts
    count as one blank: such a text is blank, such a role is none of the three, as is an empty one. A null
    ``conv_id`` is a conversation of its own; null turns come first and count in no gap; repeated rows are
    duplicates; a conversation without rows has zeros, an empty audit and the digest of nothing; an empty table gives
    an empty result. Extra columns take no part.

    Texts stream through the task of their conversation in order, one line at a time into a running digest, so
    a conversation with a third of all rows needs time there (a digest of lines in order has no other way) but
    no memory; its faults and edits are worked out from small rows dealt over all tasks."""
    whole = ordered(rows)
    lined = lined_up(whole, plans(whole))
    about = lined.schema["plan"].dataType.fields

    def hash_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, plan, edited, digest, lines = None, None, None, None, 0

        def add(found: Iterable[tuple[str, str]]) -> None:
            nonlocal lines
            for role, text in found:
                digest.update(("\n" * (lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                lines += 1

        def finished() -> dict:
            add(edited.inserts())
            return plan | {"repaired_sha256": digest.hexdigest()}

        def batch_of(ids: list[pa.Array], out: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([r[f.name] for r in out], pa.string() if f.name == "audit" else pa.int64()) for f in about]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns, pa.array([r["repaired_sha256"] for r in out])], names=["conv_id", *(f.name for f in about), "repaired_sha256"])

        for batch in batches:
            ids, out = [], []
            for k, (head, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                if head is not None:
                    if key is not None:
                        ids.append(key)
                        out.append(finished())
                    key, plan, edited, digest, lines = batch.column(0).slice(k, 1), head, Edited(head["audit"]), hashlib.sha256(), 0
                else:
                    add(edited.row(role, text))
            if out:
                yield batch_of(ids, out)
        if key is not None:
            yield batch_of([key], [finished()])

    return lined.mapInArrow(hash_lines, StructType([lined.schema["conv_id"], *about, *StructType.fromDDL("repaired_sha256 string").fields]))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 0), ``role`` and ``text`` of every row of the repaired conversations."""
    whole = ordered(rows)
    lined = lined_up(whole, plans(whole))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, edited, place = None, None, 0
        for batch in chain(batches, [None]):
            ids, out = [], []
            heads = zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True) if batch is not None else [({"audit": ""}, None, None)]
            for k, (head, role, text) in enumerate(heads):
                found = ([] if edited is None else edited.inserts()) if head is not None else edited.row(role, text)
                for new_role, new_text in found:
                    ids.append(key)
                    out.append((place, new_role, new_text))
                    place += 1
                if head is not None and batch is not None:
                    key, edited, place = batch.column(0).slice(k, 1), Edited(head["audit"]), 0
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names=["conv_id", "place", "role", "text"])

    schema = StructType([lined.schema["conv_id"], *StructType.fromDDL("place long, role string, text string").fields])
    return lined.mapInArrow(write, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """The digests of ``conversations`` after damage and repair."""
    return repair_digests(damage(conversations))
