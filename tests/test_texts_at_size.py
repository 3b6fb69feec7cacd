"""Text work that large tables made too slow: the faster form against the plain one."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from ledgerloom.functions import text, text_pairs
from ledgerloom.functions.storage import written
from ledgerloom.operators import curation, extraction, lines, operations, quality


def test_xml_values_are_read_by_two_paths(spark):
    body = (
        "<a:Invoice xmlns:a='urn:a'><a:ID> N1 </a:ID><x><a:ID>late</a:ID></x><a:IssueDate>2024-03-04</a:IssueDate><a:IssueTime>10:11:12</a:IssueTime>"
        "<a:AccountingSupplierParty><a:PartyName><a:Name>First</a:Name></a:PartyName><a:PartyName><a:Name>Second</a:Name></a:PartyName></a:AccountingSupplierParty>"
        "<a:LegalMonetaryTotal><a:TaxInclusiveAmount>118.00</a:TaxInclusiveAmount></a:LegalMonetaryTotal><a:PaymentMeansCode>42</a:PaymentMeansCode></a:Invoice>"
    )
    rows = [(1, body), (2, "<Invoice><open>"), (3, None), (4, "<Invoice><RegistrationName>R</RegistrationName></Invoice>")]
    found = lines.xml_invoices(spark.createDataFrame(rows, "payload_id long, payload string"))
    one, two, three, four = found.orderBy("payload_id").collect()
    assert (one["document_number"], one["merchant"], one["date"], one["time"]) == ("N1", "First", datetime.date(2024, 3, 4), "10:11")
    assert (one["total_minor"], one["subtotal_minor"], one["tax_id"], one["currency"]) == (11800, None, None, "TRY")
    assert two["document_number"] is None and "MALFORMED_DOCUMENT" in two["issues"] and three["merchant"] is None and four["merchant"] is None
    # every call of a path function parses the text again
    assert found._jdf.queryExecution().optimizedPlan().toString().count("xpath_string(") <= 2


def plain_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances_of_any_length_and_alphabet(spark):
    dice = random.Random(4)
    pairs = [("", ""), ("", "abc"), ("a", ""), (None, "a"), ("a", None), ("şğ😀", "sg"), ("x" * 64, "x" * 65), ("ab" * 64, "ba" * 64), ("q" * 700, "p" * 20)]
    for alphabet in ("ab", "abcdefghijklmnop .,1", "abçşİ€😀𐍈"):
        for size in (5, 63, 64, 65, 130, 300):
            for _ in range(20):
                own = "".join(dice.choices(alphabet, k=dice.randint(size // 2, size)))
                other = "".join(dice.choices(alphabet, k=size)) if dice.random() < 0.3 else "".join(c for c in own if dice.random() < 0.9)
                pairs.append((own, other + dice.choice(["", "z"])))
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").coalesce(1)
    found = rows.select("k", text_pairs.edits("a", "b").alias("d"), F.levenshtein("a", "b").alias("plain")).collect()
    assert len(found) == len(pairs)
    for row in found:
        a, b = pairs[row["k"]]
        assert row["d"] == row["plain"] == (None if a is None or b is None else plain_distance(a, b)), (a, b)


def test_word_errors_and_special_letters_of_a_pair(spark):
    pairs = [("a b c", "a x c", 1 / 3), (" a\tb\n", "a b", 0.0), ("", "a", 1.0), ("", "", 0.0), (None, "a", None), ("a", None, None), ("ş b c", "ş b c", 1.0)]
    pairs += [(" ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(0, 200, 2)), 0.5)]
    rows = spark.createDataFrame(pairs, "r string, h string, want double")
    assert all(r["got"] == r["want"] for r in rows.select(quality.wer(F.col("r"), F.col("h")).alias("got"), "want").collect())
    texts = [("çğı I", "çç Iİ"), ("", ""), (None, "çç"), ("ğğı", None), (None, None), ("abc", "abc"), ("Şş", "şŞ")]
    own = spark.createDataFrame(texts, "r string, h string").select("*", text_pairs.shared_letters("çğıİşŞI")("r", "h").alias("n"))
    assert [tuple(r["n"]) for r in own.collect()] == [(4, 4, 2), (0, 0, 0), (None, 2, 2), (3, None, 3), (None, None, None), (0, 0, 0), (2, 2, 2)]


def test_lines_are_folded_together_as_each_alone(spark):
    dice = random.Random(8)
    texts = ["", " ", "\n\n", "a\rb\r\nc", "{x}\n{\n}y", "İŞLEM  ığ\n\tÇ\x0bd\f e \ń\nSTRASSE ß", None, "Σ\nΣας Σ.", "a \n b", "12,50 TL\n-"]
    texts += ["".join(dice.choices("aZ{}9 .,\t\n\r\x0b\fİıçé́ΣK ₺", k=60)) for _ in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, normalized string")
    plain = F.filter(F.transform(F.split(F.translate("normalized", "\r", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    made = extraction.with_lines(rows).withColumn("plain", plain)
    found = made.select("normalized", "lines.text", "lines.folded", "lines.no", "plain", F.transform("plain", text.fold).alias("each"), F.col("folded").alias("whole"), text.fold(F.col("normalized")).alias("want"))
    for row in found.toDF("normalized", "text", "folded", "no", "plain", "each", "whole", "want").collect():
        assert (row["text"], row["folded"]) == (row["plain"], row["each"]), row
        assert row["whole"] == row["want"] and row["no"] == (None if row["plain"] is None else list(range(len(row["plain"])))), row
    # one search folds the lines of a text, whatever their number
    plan = extraction.with_lines(rows).select("lines")._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9](?<!" not in plan


def test_order_of_matches_is_counted_in_the_row_of_a_small_document(spark, monkeypatch):
    dice = random.Random(3)
    rows = [(d, t, p) for d, n in enumerate((1, 2, 5, 9, 30)) for t, p in enumerate(dice.sample(range(40), n))]
    rows += [(7, None, 3), (7, 2, None), (7, 5, 9)]
    matches = spark.createDataFrame(rows, "doc_id int, truth int, pred int")
    own = {d: [(t is not None, t or 0, p is not None, p or 0) for e, t, p in rows if e == d] for d in {r[0] for r in rows}}
    want = {d: sum(a[2:] < b[2:] for a in ms for b in ms if a[:2] < b[:2]) for d, ms in own.items()}
    for few in (64, 4, 0):
        monkeypatch.setattr(curation, "FEW_MATCHES", few)
        found = curation.ordered_pairs(matches)
        assert {r["doc_id"]: (r["pairs"], r["in_order"]) for r in found.collect()} == {d: (len(ms) * (len(ms) - 1) // 2, want[d]) for d, ms in own.items()}, few


def test_a_round_of_matches_deals_rows_three_times(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(curation, "written", kept)
    pairs = spark.createDataFrame([(1, 7, 7, 0.75), (1, 7, 8, 0.6), (1, 9, 8, 0.55), (2, None, 1, 0.9)], "doc_id int, truth int, pred int, iou double")
    found = curation.greedy_matches(pairs).collect()
    assert sorted(map(tuple, found), key=repr) == [(1, 7, 7, 0.75), (1, 9, 8, 0.55), (2, None, 1, 0.9)]
    windows = [line.split("[doc_id")[1].split("]")[0].split("#")[1].split(", ")[1] for line in plans[0].splitlines() if "Window [" in line]
    assert windows == ["truth", "pred", "pred", "truth"]


def test_events_of_one_list_of_endpoints_lie_together(spark, monkeypatch):
    monkeypatch.setattr(operations, "FAN_LIST", 8)
    outbox = spark.range(400).select("id", (F.col("id") % 5).alias("tenant_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("topic"))
    topics = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    endpoint = spark.range(200).select("id", (F.col("id") % 5).alias("tenant_id"), F.lit(True).alias("enabled"), topics.alias("event_types"))
    found = operations.event_subscriptions(outbox, endpoint)
    rows = found.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    want = {(e, k) for e in range(400) for k in range(200) if e % 5 == k % 5 and (k % 2 == 0 or e % 3)}
    assert len(rows) == len(want) and {(r["event_id"], r["endpoint_id"]) for r in rows} == want
    tasks = len({r["task"] for r in rows})
    groups = [(r["task"], r["tenant_id"], r["topic"]) for r in rows]
    # a tenant and topic begins once in a task
    assert sum(a != b for a, b in zip(groups, groups[1:])) < tasks * 10


def test_a_phrase_is_searched_before_its_blanks(spark):
    texts = [" fis ", " xfis ", " fisx fis ", " e arsiv ", " earsivx ", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(text.says(F.col("t"), r"\bfis\b").alias("fis"), text.says(F.col("t"), r"\be\s*arsiv\b").alias("e"))
    assert [tuple(r) for r in found.collect()] == [(True, False), (False, False), (True, False), (False, True), (False, False), (False, False), (None, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(t#" in plan and ", fis) AND" in plan
