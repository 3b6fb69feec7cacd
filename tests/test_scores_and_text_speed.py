"""Scores that no row order decides, and text rules in their fast form against the plain one."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import curation, extraction, quality


def test_mean_overlap_does_not_follow_the_order_of_rows(spark):
    for values in itertools.permutations((0.874, 0.8296875, 0.95)):
        rows = spark.createDataFrame([(v,) for v in values], "iou double").coalesce(1)
        assert rows.agg(curation.steady_mean("iou")).first()[0] == 0.884563


def test_boxes_under_one_number_match_once(spark):
    rows = [(1, 7, 7, 0.75), (1, 7, 7, 0.75), (1, 7, 8, 0.6), (1, 9, 8, 0.55)]
    pairs = spark.createDataFrame(rows, "doc_id int, truth int, pred int, iou double")
    found = curation.greedy_matches(pairs).orderBy("truth").collect()
    assert [tuple(r) for r in found] == [(1, 7, 7, 0.75), (1, 9, 8, 0.55)]


def test_phrases_find_what_their_patterns_find(spark):
    texts = ["fis", "earsiv no", "e arsiv", "xfis", "genel toplam 5", "islem tutari", "islem", "ode eft", "v d", "vd", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [p for c in extraction.CLASSES for p in c[5]] + [extraction.BANK_AMOUNT, extraction.BANK_FEE]
    spaced = F.concat(F.lit(" "), F.col("t"), F.lit(" "))
    assert set(text.phrases(r"\be\s*arsiv\b")) == {"e arsiv", "earsiv"}
    for p in patterns:
        for row in rows.select(F.col("t").rlike(p).alias("a"), text.says(spaced, p).alias("b")).collect():
            assert row["a"] == row["b"], p


def test_word_error_rate_binds_the_words_of_a_pair(spark):
    pairs = [("a b c", "a x c", 1 / 3), ("a b", "a b", 0.0), ("", "a", 1.0), ("a  b", "", 1.0), (" ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60)), 1.0)]
    rows = spark.createDataFrame(pairs, "r string, h string, want double")
    found = rows.select(quality.wer(F.col("r"), F.col("h")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in found.collect())
    # both texts are split once each, not once more for every word
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4
