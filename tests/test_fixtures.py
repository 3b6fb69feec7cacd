"""Literal cases for rules the test tables rarely reach."""

import datetime as dt
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, groups, money, text
from ledgerloom.operators import categories, curation, extraction, lifecycle, lines, quality, spend

EXPENSE = (
    "id long, workspace_id int, merchant_name string, title string, category_id string, currency string, amount_minor long, "
    "occurred_at timestamp_ntz, business_expense boolean, reimbursable boolean, status string, archived_at timestamp_ntz, "
    "payment_method_name string"
)


def expense(spark, *rows):
    full = [(i, 1, m, "t", c, "TRY", a, at, b, r, "DRAFT", None, "card") for i, (m, c, a, at, b, r) in enumerate(rows)]
    return spark.createDataFrame(full, EXPENSE)


def test_insights_golden(spark):
    e = expense(
        spark, ("A", "food", 67500, datetime(2026, 5, 4), True, False), ("B", None, 22500, datetime(2026, 5, 4), True, True),
        ("C", "food", 137500, datetime(2026, 5, 9), True, False), ("A", "food", 100000, datetime(2026, 4, 8), False, False))
    b = spark.createDataFrame([(1, 1, None, "all", "TRY", 60000, 80)],
                              "id int, workspace_id int, category_id string, name string, currency string, amount_minor long, alert_percent int")
    row = spend.finance_insights(e, b).where("month = '2026-05-01'").collect()[0]
    assert (row.spend_minor, row.previous_month_minor, row.delta_minor) == (227500, 100000, 127500)
    assert (row.observed_days, row.daily_average_minor, row.projected_minor) == (2, 113750, 3526250)
    months = spend.month_totals(spend.daily_spend(e))
    usage = spend.budget_usage(e, b, months.select("workspace_id", "month"))
    risk = spend.largest_budget_risk(usage, months).where("month = '2026-05-01'").collect()[0]
    assert risk.projected_overspend_minor == 3466250
    codes = {r.code for r in spend.anomaly_summary(e, months, spend.budget_alerts(usage)).where("month = '2026-05-01'").collect()}
    assert {"WEEKEND_BUSINESS_EXPENSE", "BUDGET_OVER_UTILIZED"} <= codes


def test_month_overflow_and_gap_edges(spark):
    day = spark.createDataFrame([(datetime(2023, 1, 31, 8),), (datetime(2023, 1, 15),)], "d timestamp_ntz")
    got = [r.x for r in day.select(dates.add_month_overflowing(F.col("d")).alias("x")).collect()]
    assert got == [datetime(2023, 3, 3, 8), datetime(2023, 2, 15)]
    for gap, cadence in ((4, None), (5, "weekly"), (10, "weekly"), (11, None), (24, None), (25, "monthly"), (45, "monthly"), (46, None)):
        start = datetime(2024, 1, 1)
        rows = expense(spark, ("Gym", None, 500, start, False, False), ("gym ", None, 500, start + dt.timedelta(days=gap), False, False))
        found = lifecycle.recurring_candidates(rows).collect()
        assert [r.cadence for r in found] == ([cadence] if cadence else [])


def test_peer_anomalies_need_three_and_five_peers(spark):
    base = datetime(2024, 5, 6)
    rows = [("M", None, 100, base, False, False)] * 3 + [("N", None, 301, base, True, False)]
    codes = lambda df: {(r.id, r.code) for r in lifecycle.expense_anomalies(lifecycle.peer_profile(df)).collect()}
    assert (3, "UNUSUALLY_HIGH_AMOUNT") in codes(expense(spark, *rows))
    rows[3] = ("N", None, 300, base, True, False)
    assert (3, "UNUSUALLY_HIGH_AMOUNT") not in codes(expense(spark, *rows))
    assert (3, "UNUSUAL_MERCHANT") not in codes(expense(spark, *rows))
    assert (5, "UNUSUAL_MERCHANT") in codes(expense(spark, *(rows[:3] * 2)[:5], rows[3]))


@pytest.mark.parametrize("raw, minor", [
    ("1.234,56 TL", 123456), ("1,234.56", 123456), ("-12,5", -1250), ("12", 1200), ("12.", None), ("1,2,3", None), ("abc", None)])
def test_locale_amounts(spark, raw, minor):
    got = spark.createDataFrame([(raw,)], "t string").select(money.parse_locale_amount(F.col("t")).alias("m")).collect()[0].m
    assert (None if got is None else int(got)) == minor


def test_text_folding(spark):
    df = spark.createDataFrame([("  İSTANBUL Şişli-ığ  Café",)], "t string")
    assert df.select(text.fold(F.col("t"))).collect()[0][0] == "istanbul sisli ig cafe"


RECEIPT = """ORNEK MARKET LTD
TARIH: 05.07.2024 SAAT: 14:05
FIS NO: 00123
SOT %10 1O,00
Ekmek 2 x 5,00 10,00
ARA T0PLAM 20,00
KDV 2,00
GENEL T0PLAM 22,00 TL
KREDI KARTI **** 4242"""


def test_receipt_chain(spark):
    docs = spark.createDataFrame([(1, "TESSERACT", RECEIPT, 0.9)], "doc_id int, engine string, text string, confidence double")
    r = extraction.extract_fields(docs, "2024-08-01").collect()[0]
    assert r.document_type == "retail_receipt" and r.total_minor == 2200 and r.subtotal_minor == 2000 and r.tax_minor == 200
    assert str(r.date) == "2024-07-05" and r.time == "14:05" and r.payment_method == "CARD" and r.card_last4 == "4242"
    assert "MONEY_DIGIT_CONFUSION" in r.corrections and "TOTAL_LABEL" in r["corrections"]
    assert [i.total_minor for i in r["items"]] == [1000, 1000] and r["items"][1].unit_price_minor == 500
    assert [i.code for i in r.issues] == [] and r.readiness > 0.8


def test_category_ties_follow_dictionary_order(spark):
    df = spark.createDataFrame([("market taksi",), ("benzin opet",), ("nothing",)], "t string")
    got = [r.category for r in categories.keyword_category(df, "t").collect()]
    assert got == ["market", "akaryakit", "diger"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_word_errors_and_alignment_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [(" ".join(rng.choices("ab cd ef g".split(), k=rng.randint(1, 9))), " ".join(rng.choices("ab cd ef g".split(), k=rng.randint(1, 9))))
             for _ in range(60)]
    df = spark.createDataFrame([(i, "e", a, b, None) for i, (a, b) in enumerate(pairs)],
                               "sample_id int, engine string, reference string, prediction string, error_code string")
    got = {r.sample_id: r.wer for r in quality.word_error_rates(df).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(levenshtein(a.split(), b.split()) / len(a.split()), abs=1e-6)
    confusions = quality.char_confusions(df).agg(F.sum("count")).collect()[0][0]
    assert confusions == sum(levenshtein(a, b) for a, b in pairs)


def test_box_matching_against_brute_force(spark):
    rng = random.Random(3)
    boxes = []
    for doc in range(8):
        for kind in ("truth", "pred"):
            for k in range(12):
                x, y = rng.randint(0, 300), rng.randint(0, 300)
                boxes.append((doc, kind, k, x, y, x + rng.randint(20, 200), y + rng.randint(20, 200)))
    df = spark.createDataFrame(boxes, "doc_id int, kind string, ord long, x1 long, y1 long, x2 long, y2 long")

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        if w <= 0 or h <= 0:
            return 0.0
        area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
        return w * h / (area(a) + area(b) - w * h)

    want = {(a[0], a[2], b[2]): iou(a, b) for a in boxes for b in boxes if a[0] == b[0] and a[1] == "truth" and b[1] == "pred" and iou(a, b) > 0}
    got = {(r.doc_id, r.truth, r.pred): r.iou for r in curation.box_pairs(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    matched = curation.greedy_matches(curation.box_pairs(df), 0.2).collect()
    taken = set()
    for (doc, t, p), v in sorted(((k, v) for k, v in want.items() if v >= 0.2), key=lambda kv: (-kv[1], kv[0])):
        if ("t", doc, t) not in taken and ("p", doc, p) not in taken:
            taken |= {("t", doc, t), ("p", doc, p)}
    assert len(matched) == len(taken) // 2


def test_positions_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 50), i) for i in range(3000)] + [("hot", 7, 10_000 + i) for i in range(2000)]
    want = {}
    for key in ("a", "b", "hot"):
        for pos, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[r] = pos
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k string, v int, id int").repartition(parts)
        got = groups.positions(df, ["k"], [F.desc("v"), F.asc("id")])
        assert {(r.k, r.v, r.id): r.position for r in got.collect()} == want


def test_payloads(spark):
    rows = [(1, "https://x/?firma=Shop+A&tarih=01022024&tutar=12%2C50&fisNo=9"), (2, '{"merchant":"B","total":"10.00","kdv":"1.00","araToplam":"7.00"}'),
            (3, "unvan: Kafe; toplam: 5,25; saat: 9:05"), (4, "")]
    got = {r.payload_id: r for r in lines.qr_payloads(spark.createDataFrame(rows, "payload_id int, payload string")).collect()}
    assert str(got[1].date) == "2024-02-01" and got[1].total_minor == 1250 and got[1].merchant in ("Shop A", "Shop+A")
    assert "TOTAL_TAX_MISMATCH" in got[2].issues and got[3].total_minor == 525 and got[3].time == "09:05"
    assert "MALFORMED_DOCUMENT" in got[4].issues
