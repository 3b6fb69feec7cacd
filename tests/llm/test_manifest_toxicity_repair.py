"""Manifest, toxicity and conversation repair against brute force, with odd rows."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversation_repair, merkle, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- manifest


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return out


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        text = r["text"]
        if text is not None and zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 0:
            text = text.translate(LOWER)
        leaf, checked = (digest("".join(encoded(t if c == "text" else r[c]) for c in merkle.FIELDS)) for t in (r["text"], text))
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, checked, r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([r[2] for r in sorted(groups[g])]) for g in names}
    top = tree_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, folded, doc_id) in enumerate(sorted(groups[g])):
            path = path_of(trees[g], i) + path_of(top, k)
            for left, right in path:
                folded = digest(left + folded + right)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted_rows(merkle.verified(docs)) == brute_manifest([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("size", [1, 65, 4700])
def test_trees_of_every_height_with_nulls_repeats_and_clashing_names(spark, size):
    """Groups of one leaf, of whole runs and of several stored levels side by side; more than eight groups."""
    rows = [(i, f"Text {i}", "big", "s", i) for i in range(size)] + [(i, "x", f"l{i}", None, None) for i in range(11)]
    rows += [(None, None, None, None, None), (5, "", None, "", 0), (3, "Twice", "é", "s", 1), (3, "Twice", "é", "s", 1), (3, "Other", "é", "s", 1), (None, "A", "é", "s", 1)]
    docs = spark.createDataFrame(rows, DOC)
    want = brute_manifest([r.asDict() for r in docs.collect()])
    crowded = docs.withColumns({c: F.lit("clash") for c in ("leaf", "tree", "digest", "pos", "size", "path", "about", "rows")})
    assert sorted_rows(merkle.verified(crowded.repartition(5))) == want


def test_an_empty_manifest_and_a_changed_text(spark):
    docs = spark.createDataFrame([(i, f"Text {i}", "a", "s", 1) for i in range(20)], DOC)
    assert merkle.verified(docs.limit(0)).collect() == []
    got = merkle.manifest(docs, F.when(F.col("doc_id") == 7, F.lit("forged")).otherwise(F.col("text"))).collect()
    assert {r["doc_id"] for r in got if r["folded_root"] != r["root"]} == {7}


# ---- toxicity


def slow_features(text):
    """The n-grams one by one, with the same hash."""
    text, mask = " " + " ".join((text or "").lower().split()) + " ", 0xFFFFFFFF
    counts = collections.Counter()
    for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
        for i in range(len(text) - n + 1):
            h = ord(text[i]) * 0x9E3779B1 & mask
            for c in text[i + 1 : i + n]:
                h = ((h ^ h >> 15) * 0x85EBCA6B + ord(c) * 0x9E3779B1) & mask
            counts[((h ^ h >> 13) * 0xC2B2AE35 & mask) >> 13] += 1
    return sorted(p + g * toxicity.SPACE for p, c in counts.items() for g, least in enumerate(toxicity.GRADES) if c >= least)


def test_features_match_a_slow_count_also_piece_by_piece(monkeypatch):
    texts = [None, "", " ", "ab", "Über 日本語 a\tb\n c", "aaaaaaaaaa", "the cat sat on the mat " * 3, "\ud800 x y"]
    assert toxicity.SPACE == 1 << 19
    for piece in (toxicity.PIECE, 7):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        for text in texts:
            assert sorted(toxicity.features(text).tolist()) == slow_features(text)


def slow_scores(texts, labels):
    """Ratios, scalar updates in the same order, and scores of few texts."""
    found = {k: slow_features(t) for k, t in texts.items()}
    taught = [k for k in sorted(labels)]
    by = {y: collections.Counter(f for k in taught if labels[k] == y for f in found[k]) for y in (0, 1)}
    n = {y: sum(labels[k] == y for k in taught) for y in (0, 1)}
    ratio = {f: float(np.float32(math.log((by[1][f] + 1) / (n[1] + 2)) - math.log((by[0][f] + 1) / (n[0] + 2)))) for f in by[0] | by[1] if by[0][f] + by[1][f] >= toxicity.LEAST_TEXTS}
    z, m = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= toxicity.L1 else (math.copysign(toxicity.L1, z[f]) - z[f]) / ((toxicity.BETA + math.sqrt(m[f])) / toxicity.ALPHA + toxicity.L2)

    def values(k):
        size = float(np.float32(max(len(found[k]), 1) ** toxicity.NORM))
        return {f: ratio[f] / size for f in found[k] if ratio.get(f)} | {"constant": 1.0}

    return found, ratio, z, m, weight, values


def test_weights_match_scalar_updates(spark):
    rng = random.Random(2)
    words = ["good", "day", "tree", "river", "stone", "night", "paper", "light"]
    texts = {i: " ".join(rng.choice(words) for _ in range(12)) + (" vile scum" * 2 if i % 3 == 0 else "") for i in range(60)}
    labels = {i: int(i % 3 == 0) for i in texts if zlib.crc32(str(i).encode()) % 5}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in texts], "doc_id long, quality int, toxic int")
    order = [r[0] for r in spark.createDataFrame([(i,) for i in labels], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(7))).collect()]
    found, ratio, z, m, weight, values = slow_scores(texts, labels)
    for _ in range(toxicity.PASSES):
        for k in order:
            v = values(k)
            w = {f: weight(f) for f in v}
            error = 1 / (1 + math.exp(-sum(w[f] * x for f, x in v.items()))) - labels[k]
            for f, x in v.items():
                g = error * x
                z[f] += g - (math.sqrt(m[f] + g * g) - math.sqrt(m[f])) / toxicity.ALPHA * w[f]
                m[f] += g * g
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs.repartition(3), table).collect()}
    assert len(got) == 60
    for k in texts:
        total = sum(weight(f) * ratio.get(f, 0.0) for f in found[k]) / max(len(found[k]), 1) ** toxicity.NORM + weight("constant")
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-4)
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.5) == int(k % 3 == 0)
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_weights_do_not_follow_the_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    few, many = (toxicity.train(docs.repartition(n), labels) for n in (4, 211))
    assert np.array_equal(few, many) and np.count_nonzero(few) > 10


def test_toxic_documents_are_found_in_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in toxicity.toxicity(docs, labels).join(labels, "doc_id").collect() if r["held_out"]]
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "text", "x"), (4, "a" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()] == [0.5] * 5
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


# ---- conversation repair

AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """Cost, audit and lines by a uniform-cost search in the order of (cost, audit)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        new, name = (3, "assistant") if state == 2 else (2, "user")
        heapq.heappush(heap, (cost + 3, audit + "I", i, new, (*out, name + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            extra = 3 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                if (state, role[:1]) in AFTER:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, AFTER[state, role[:1]], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, new, (*out, f"{name}:{text}")))


def brute_repair(data):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in data:
        own = convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        tie = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own.extend([(turn is not None, turn or 0, tie, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = []
    for conv, rows in convs.items():
        rows.sort()
        seen, faulty, n = set(), [], collections.Counter()
        for *_, role, text in rows:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
            n[fault] += 1
        turns = [r[1] for r in rows if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest(faulty)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest("\n".join(lines))))
    return sorted(out, key=repr)


NAMES = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}


def test_search_finds_the_least_cost_and_audit():
    rng = random.Random(5)
    lengths = [rng.randrange(9) for _ in range(3000)] + [conversation_repair.STRETCH] * 20
    for n in lengths:
        codes = "".join(rng.choice("suauauaDoUASO") for _ in range(n))
        rows = [(NAMES.get(c.lower(), "user"), "", "blank" if c == "D" else "truncated" if c.isupper() else "") for c in codes]
        assert conversation_repair.solve(codes) == cheapest(rows)[:2]


def test_bounds_never_exceed_the_true_rest():
    rng = random.Random(6)
    for _ in range(500):
        codes = "".join(rng.choice("suauaDoUASO") for _ in range(rng.randrange(7)))
        bounds = conversation_repair.Bounds(codes, (0, 3))
        for i in range(len(codes) + 1):
            for state in range(4):
                assert bounds.rest(i, state) <= conversation_repair.solve(codes[i:], state)[0]


def test_repair_matches_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = brute_repair([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert sorted_rows(conversation_repair.repaired(table)) == want


def test_long_conversations_ties_nulls_and_clashing_names(spark):
    """One conversation over many stretches and tasks, null turns, odd roles, repeated rows, none left."""
    rng = random.Random(7)
    texts = ["a.", "b", "c!", None, "", " d?", "é　", "x.\x0b\n "]
    rows = [(1, i // 2 if i % 7 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*texts, f"t{i}.", f"u{i}", f"v{i}?"])) for i in range(1500)]
    dropped = next(i for i in range(100, 999) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows += [(None, None, "user", "hi."), (2, None, None, None), (3, 5, "system", "x."), (4, 1, "user", "q?"), (4, 1, "user", "q?"), (4, 9, "assistant", "r."), (dropped, 1, "user", "gone.")]
    crowded = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("tie", "kind", "plan", "seq", "audit", "body")})
    want = brute_repair(rows)
    for parts in (1, 7):
        assert sorted_rows(conversation_repair.repaired(crowded.repartition(parts))) == want
    assert (dropped, 0, 0, 0, 0, 0, 0, "", digest("")) in want
    lines = collections.defaultdict(list)
    for r in sorted(conversation_repair.repaired_rows(conversation_repair.damage(crowded)).collect(), key=lambda r: r["place"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {w[0]: w[-1] for w in want} == {w[0]: digest("\n".join(lines[w[0]])) for w in want}
    assert conversation_repair.repaired(crowded.limit(0)).collect() == []


def test_repair_of_given_rows(spark):
    """Rows as they are, without damage; a string id."""
    rows = [("c", 1, "system", "s."), ("c", 2, "user", "u?"), ("c", 4, "user", "v?"), ("c", 5, "assistant", "w")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert sorted_rows(conversation_repair.repair_digests(df)) == [("c", 1, 0, 0, 1, 1, 6, "KKIKK", digest("system:s.\nuser:u?\nassistant:\nuser:v?\nassistant:w"))]
