"""Router fits against plain Newton conditions, thresholds by brute force, alignments of long texts."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import quality, routing


def test_long_alignment_equals_the_whole_table():
    rng = random.Random(9)
    for _ in range(120):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(60)))
        b = "".join(c if rng.random() < 0.8 else rng.choice(["", "x", c + rng.choice("abcd")]) for c in a) + rng.choice(["", "tail", "abcd" * 20])
        want = [(r, h) for _, r, h in quality._unequal_pairs([a], [b])]
        assert quality._long_unequal(a, b) == want


def test_texts_of_a_hundred_thousand_letters_fit(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    cuts = sorted(rng.sample(range(100_000), 60))
    b = list(a)
    for k, at in enumerate(cuts):
        b[at] = ("é", "", a[at] + "ß")[k % 3]
    start = time.time()
    rows = spark.createDataFrame([("e", a, "".join(b), None), ("e", "abc", "abxc", None)], "engine string, reference string, prediction string, error_code string")
    got = {(r["reference_char"], r["predicted_char"]): r["count"] for r in quality.char_confusions(rows).collect()}
    assert sum(n for (_, h), n in got.items() if h == "é") == 20 and got["<inserted>", "ß"] == 20 and got["<inserted>", "x"] == 1
    assert sum(n for (_, h), n in got.items() if h == "<deleted>") == 20
    assert time.time() - start < 60


@pytest.fixture(scope="module")
def pairs(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(600):
        good = rng.random() < 0.5
        champion, challenger = "Toplam 12,5" + "x" * int(rng.integers(0, 5)), "Toplam 12,50 TL" if good else "Tpl"
        rows.append((int(i % 40), champion, challenger, float(rng.random()), float(rng.random()), float(rng.random()), float(rng.random()), "amount" if i % 3 else "general_text",
                     float(rng.integers(1, 12)), 1, 2, 30, 9, 0.3, 0.1 if good else 0.5))
    columns = "doc_id int, champion_text string, challenger_text string, champion_confidence double, challenger_confidence double, champion_score double, challenger_score double, line_role string, aspect_ratio double, x int, y int, w int, h int, champion_cer double, challenger_cer double"
    return spark.createDataFrame(rows, columns)


def test_features_have_their_names_and_values(spark, pairs):
    row = routing.pair_features(pairs).first()
    got = dict(zip(routing.FEATURES, row["features"], strict=True))
    assert len(got) == 56 and got["box_width"] == 30 and got["role_amount"] + got["role_general_text"] == 1
    text = row["champion_text"]
    assert (got["champion_length"], got["champion_digit_count"], got["champion_space_count"]) == (len(text), 3, 1)
    assert got["challenger_to_champion_length"] == (len(row["challenger_text"]) + 1) / (len(text) + 1)


def test_every_fold_model_is_a_minimum_and_none_sees_its_fold(pairs):
    rows = routing.training_rows(routing.pair_features(pairs), 3)
    model, data = routing.fit(rows, 3), rows.collect()
    x, y, fold = np.array([r["features"] for r in data]), np.array([r["label"] for r in data]), np.array([r["fold"] for r in data])
    assert len(set(fold)) == 3
    for k in range(4):
        inside = fold != k
        assert np.allclose(model["means"][k], x[inside].mean(axis=0))
        scale = x[inside].std(axis=0)
        scale[scale < 1e-9 * np.maximum(abs(model["means"][k]), 1)] = 1
        z = np.hstack([(x[inside] - x[inside].mean(axis=0)) / scale, np.ones((inside.sum(), 1))])
        n, wins = inside.sum(), y[inside].sum()
        w = np.where(y[inside] == 1, n / (2 * wins), n / (2 * (n - wins)))
        p = 1 / (1 + np.exp(-z @ model["weights"][k]))
        slope = z.T @ (w * (p - y[inside])) + np.append(np.full(z.shape[1] - 1, routing.PENALTY), 0) * model["weights"][k]
        assert abs(slope).max() < 1e-5
    scored = {(r["doc_id"], r["challenger_cer"]): r["probability"] for r in routing.out_of_fold(rows, model).collect()}
    assert all((p > 0.5) == (cer < 0.3) for (_, cer), p in scored.items())


def test_the_threshold_gains_most_without_regressions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0.3, float(0.3 - rng.choice([0.2, 0.0, 0.01])), float(p)) for i, p in enumerate(rng.uniform(0.9, 1.0, 400))] + [(900, 0.3, 0.35, 0.955)]
    scored = spark.createDataFrame(rows, "doc_id int, champion_cer double, challenger_cer double, probability double")
    table = {round(r["threshold"], 2): r for r in routing.thresholds(scored).collect()}
    for cut, r in table.items():
        chosen = [(a - b) for _, a, b, p in rows if p >= cut]
        assert (r["selected"], r["wins"], r["regressions"]) == (len(chosen), sum(g > 0.02 for g in chosen), sum(-g > 0.02 for g in chosen))
        assert r["average_gain"] == pytest.approx(sum(chosen) / len(rows))
    assert not table[0.95]["allowed"] and [c for c, r in table.items() if r["chosen"]] == [0.96]
    assert routing.chosen_threshold(routing.thresholds(scored.where(F.col("probability") < 0.5))) is None
    with pytest.raises(ValueError):
        routing.fit(routing.training_rows(spark.createDataFrame([], "doc_id int, champion_cer double, challenger_cer double, features array<double>")))


def test_categories_are_scored_on_rows_that_did_not_teach(spark):
    from ledgerloom.operators import categories

    rows = [(i, "market" if i % 2 else "taksi", f"{'bakkal ekmek' if i % 2 else 'taksi yol'} {i}") for i in range(200)]
    taught, held = categories.held_out(spark.createDataFrame(rows, "id long, category_id string, features_text string"))
    ids = [{r["id"] for r in part.collect()} for part in (taught, held)]
    assert not ids[0] & ids[1] and len(ids[0] | ids[1]) == 200 and len(ids[1]) > 20
    got = categories.category_score(categories.category_train(taught, iterations=30), held).collect()
    assert len(got) == len(ids[1]) and all(r["predicted"] == r["category_id"] for r in got)


def test_of_several_updates_the_last_wins(spark):
    from ledgerloom.sources import sinks

    current = spark.createDataFrame([(1, 5, {"a": 1}), (2, 6, {"b": 2})], "k int, v int, m map<string,int>")
    updates = spark.createDataFrame([(1, 9, {"a": 3}, 1), (1, 7, {"a": 2}, 2), (3, 1, None, 1), (None, 4, None, 1)], "k int, v int, m map<string,int>, at int")
    got = {r["k"]: (r["v"], r["m"]) for r in sinks.merge_upsert(current, updates, ["k"], ["at"]).collect()}
    assert got == {1: (7, {"a": 2}), 2: (6, {"b": 2}), 3: (1, None), None: (4, None)}
