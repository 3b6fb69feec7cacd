"""Steps whose tasks must stay small when tables or groups grow."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import curation, operations, quality


def test_event_fan_out_is_dealt_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(operations, "FAN_LIST", 7)
    outbox = spark.range(200).coalesce(1).select("id", (F.col("id") % 2).alias("tenant_id"), F.lit("a").alias("topic"))
    topics = F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    endpoint = spark.range(40).select("id", (F.col("id") % 2).alias("tenant_id"), (F.col("id") % 5 != 0).alias("enabled"), topics.alias("event_types"))
    endpoint = endpoint.unionByName(endpoint.where("id = 1").withColumn("id", F.lit(None).cast("long")))
    found = operations.event_subscriptions(outbox, endpoint)
    want = [(e, k, e % 2, "a") for e in range(200) for k in [*range(40), *([None] if e % 2 else [])] if k is None or (k % 2 == e % 2 and k % 5)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    busy = found.groupBy(F.spark_partition_id()).count().count()
    assert busy > 1


def test_bags_are_compared_in_their_row(spark):
    rows = [
        (1, "a", ["x", "x", "y", None], ["x", "x", "x", None, "z"]), (1, "b", [], []), (2, "a", None, ["x"]), (2, "b", ["x"] * 400 + ["y"], ["y"] * 3 + ["x"] * 300),
        (None, "c", ["x"], ["y"]), (None, "c", ["y"], ["y", "x"]), (4, "d", ["a", "b"], []), (4, "d", [], ["b"]),
    ]
    bags = spark.createDataFrame(rows, "k int, e string, l array<string>, r array<string>")
    found = quality.multiset_overlap(bags, ["k", "e"], "l", "r")
    assert {tuple(r) for r in found.collect()} == {(1, "a", 4, 5, 3), (2, "a", 0, 1, 0), (2, "b", 401, 303, 301), (None, "c", 2, 3, 2), (4, "d", 2, 1, 1)}
    single = quality.multiset_overlap(bags.where("k in (1, 2)"), ["k", "e"], "l", "r")
    assert "explode" not in single._jdf.queryExecution().optimizedPlan().toString()


def test_shares_work_out_the_labels_once(spark):
    lines = spark.createDataFrame([(1, "s", "KDV 12,50", 1), (2, "t", "abc", 2), (3, "t", "12.05.2024 ref no", 1), (4, "t", None, 1)], "id int, source string, text string, hardcase_weight int")
    lines = lines.withColumn("reasons", F.array().cast("array<string>"))
    shares = curation.weighted_shares(curation.sampling_weights(lines))
    assert {(r["kind"], r["value"]) for r in shares.collect()} >= {("source", "s"), ("task", "amount"), ("task", "date_or_time"), ("task", "identifier"), ("task", "general_text")}
    assert "RLIKE" not in shares._jdf.queryExecution().optimizedPlan().toString()


def test_guards_leave_the_labels_as_the_patterns_give_them(spark):
    texts = ["iban", "an iBaN x", "FİŞ NO", "FİŞNO", "fis  no", "fatura no 1", "Belge NO", "ref no", "REFERANS no", "TR12ABCDEFGH", "tr1 x", "vkn", "TCKN 5", "no", "1.05", "10,5", "1/2/24", "9:05", "nine", "Çay", "é", "ı", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("l", curation.task_labels(F.col("t"), F.lit(False)))
    for name, pattern in (("amount", curation.AMOUNT), ("date_or_time", curation.DATE_OR_TIME), ("identifier", curation.IDENTIFIER), ("turkish_special", f"[{curation.SPECIAL_LETTERS_LINE}]")):
        for row in rows.select("t", F.array_contains("l", name).alias("a"), F.coalesce(F.trim("t").rlike(pattern), F.lit(False)).alias("b")).collect():
            assert row["a"] == row["b"], (name, row["t"])


def test_narrow_tables_give_the_whole_tables_alignment():
    rng, pairs = random.Random(5), []
    for _ in range(1500):
        a = "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 14)))
        b = "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 14))) if rng.random() < 0.5 else a.replace("a", "").replace("b", "ca")
        if a != b:
            pairs.append((a, b))
    whole = [[p[1:] for p in quality._unequal_pairs([a], [b])] for a, b in pairs]
    least = np.array([abs(len(a) - len(b)) for a, b in pairs])
    for guess in (np.array([len(w) for w in whole]), least, least + 3):
        row, r, h = quality._close_pairs([a for a, _ in pairs], [b for _, b in pairs], guess)
        got = [[] for _ in pairs]
        for k, x, y in zip(row.tolist(), r.tolist(), h.tolist(), strict=True):
            got[k].append((x, y))
        assert got == [[(int(x), int(y)) for x, y in w] for w in whole]


def test_confusions_of_close_lines_skip_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr(quality, "WHOLE_CELLS", 2_000)
    a = "the quick brown fox jumps over the lazy dog again and again until it rests"
    rows = [("e", a, a.replace("e", ""), None), ("e", a, a[::-1], None), ("f", "ab", "", None), ("f", "", "x", None), ("f", "x", "y", "BAD"), ("g", "x" * 100, "ab", None)]
    found = quality.char_confusions(spark.createDataFrame(rows, "engine string, reference string, prediction string, error_code string").coalesce(1))
    want = Counter((e, "<inserted>" if x < 0 else chr(x), "<deleted>" if y < 0 else chr(y)) for e, r, h, bad in rows if not bad for _, x, y in quality._unequal_pairs([r], [h]))
    assert {(x["engine"], x["reference_char"], x["predicted_char"]): x["count"] for x in found.collect()} == want
