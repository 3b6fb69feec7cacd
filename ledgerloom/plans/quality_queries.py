"""Recognition quality: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from .bindings import with_bindings
from .extraction_queries import ALL, EVIDENCE, ISSUES, READY, extracted
from .registry import query

CER = "levenshtein(reference, prediction) / greatest(length(reference), 1)"
SCORED = f"scored AS (SELECT *, {CER} AS cer, reference = prediction AS exact FROM prediction WHERE error_code IS NULL)"
WORDS = "list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda w: w <> '')"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("char_error_rate", with_bindings("SELECT sample_id, engine, round(cer, 6) AS cer FROM scored", SCORED))
def _(t):
    return q.error_rates(t.prediction).select("sample_id", "engine", F.round("cer", 6).alias("cer"))


@query("char_error_rate_display", with_bindings(
    f"""SELECT sample_id, engine, round(levenshtein({SQUEEZE.format('prediction')}, {SQUEEZE.format('reference')})
    / length({SQUEEZE.format('reference')}), 6) AS cer FROM prediction"""))
def _(t):
    return q.display_error_rate(t.prediction)


# Words as one ASCII letter each: a line of at most 80 characters has few enough of them.
CODED = "array_to_string(list_transform({0}, lambda w: chr(CAST(32 + list_position(known, w) AS INTEGER))), '')"
WORDED = f"""worded AS (SELECT *, levenshtein({CODED.format('rw')}, {CODED.format('hw')}) / greatest(len(rw), 1) AS wer FROM (
    SELECT *, list_distinct(list_concat(rw, hw)) AS known FROM (SELECT *, {WORDS.format('reference')} AS rw, {WORDS.format('prediction')} AS hw FROM scored)))"""


@query("word_error_rate", with_bindings("SELECT sample_id, engine, round(wer, 6) AS wer FROM worded", SCORED.replace(" WHERE error_code IS NULL", ""), WORDED))
def _(t):
    return q.word_error_rates(t.prediction)


@query("token_prf", with_bindings(
    f"""SELECT engine, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall,
      round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS macro_f1, any_value(mp) AS micro_precision, any_value(mr) AS micro_recall,
      round(any_value(CASE WHEN up + ur = 0 THEN 0 ELSE 2 * up * ur / (up + ur) END), 6) AS micro_f1
    FROM (SELECT engine, len(list_intersect(a, b)) / greatest(len(b), 1) AS p, len(list_intersect(a, b)) / greatest(len(a), 1) AS r FROM (
        SELECT engine, list_distinct(list_transform({WORDS.format('reference')}, lambda x: upper(x))) AS a,
          list_distinct(list_transform({WORDS.format('prediction')}, lambda x: upper(x))) AS b FROM prediction WHERE error_code IS NULL))
    JOIN (SELECT engine AS e2, sum(least(l, r)) / sum(r) AS up, sum(least(l, r)) / sum(l) AS ur, round(sum(least(l, r)) / sum(r), 6) AS mp, round(sum(least(l, r)) / sum(l), 6) AS mr FROM (
        SELECT engine, sample_id, w, sum(a) AS l, sum(b) AS r FROM (
          SELECT engine, sample_id, unnest({WORDS.format('reference')}) AS w, 1 AS a, 0 AS b FROM prediction WHERE error_code IS NULL
          UNION ALL SELECT engine, sample_id, unnest({WORDS.format('prediction')}), 0, 1 FROM prediction WHERE error_code IS NULL) GROUP BY ALL) GROUP BY engine) ON e2 = engine
    GROUP BY engine"""))
def _(t):
    return q.token_prf(t.prediction)


@query("multiset_overlap", with_bindings(
    f"""SELECT sample_id, engine, CAST(sum(l) AS BIGINT) AS left_size, CAST(sum(r) AS BIGINT) AS right_size, CAST(sum(least(l, r)) AS BIGINT) AS overlap FROM (
      SELECT engine, sample_id, w, sum(a) AS l, sum(b) AS r FROM (SELECT engine, sample_id, unnest({WORDS.format('reference')}) AS w, 1 AS a, 0 AS b FROM prediction
        UNION ALL SELECT engine, sample_id, unnest({WORDS.format('prediction')}), 0, 1 FROM prediction) GROUP BY ALL) GROUP BY sample_id, engine"""))
def _(t):
    rows = t.prediction.select("sample_id", "engine", q.words(F.col("reference")).alias("a"), q.words(F.col("prediction")).alias("b"))
    return q.multiset_overlap(rows, ["sample_id", "engine"], "a", "b")


def amounts(column: str) -> str:
    found = f"regexp_extract_all({column}, '{q.AMOUNT}')"
    return f"list_distinct(list_filter(list_transform({found}, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: x <> ''))"


@query("amount_prf", with_bindings(
    f"""SELECT engine, count(p) AS rows, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f1
    FROM (SELECT engine, CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / greatest(len(b), 1) END AS p,
      CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / greatest(len(a), 1) END AS r
      FROM (SELECT engine, {amounts('reference')} AS a, {amounts('prediction')} AS b FROM prediction WHERE error_code IS NULL)) GROUP BY engine"""))
def _(t):
    return q.amount_prf(t.prediction)


def letter(column: str, letters: str) -> str:
    return f"length(regexp_replace({column}, '[^{letters}]', '', 'g'))"


@query("special_letter_prf", with_bindings(
    f"""SELECT engine, round(avg(CASE WHEN a + b = 0 THEN 1 ELSE tp / greatest(b, 1) END), 6) AS precision, round(avg(CASE WHEN a + b = 0 THEN 1 ELSE tp / greatest(a, 1) END), 6) AS recall,
      round(avg(CASE WHEN a + b = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (a + b) END), 6) AS f1
    FROM (SELECT engine, {letter('reference', 'üöçéèS')} AS a, {letter('prediction', 'üöçéèS')} AS b,
      {' + '.join(f"least({letter('reference', c)}, {letter('prediction', c)})" for c in 'üöçéèS')} AS tp
      FROM (SELECT 'gamma' AS engine, text AS reference, replace(replace(text, 'é', 'e'), 'S', 'üS') AS prediction FROM documents)) GROUP BY engine"""))
def _(t):
    hyp = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e")), F.lit("S"), F.lit("üS"))
    rows = t.documents.select(F.lit("gamma").alias("engine"), F.col("text").alias("reference"), hyp.alias("prediction"),
                              F.lit(None).cast("string").alias("error_code"))
    return q.special_letter_prf(rows, "üöçéèS")


@query("char_confusions")
def _(t):
    return q.char_confusions(t.prediction)


@query("confusion_rank")
def _(t):
    return q.confusion_rank(q.char_confusions(t.prediction))


@query("snippet_recall", with_bindings(
    """SELECT engine, round(avg(CAST(contains(upper(prediction), upper(substr(reference, 1, 6))) AS INTEGER)
      + CAST(contains(upper(prediction), upper(substr(reference, 7, 5))) AS INTEGER)) / 2, 6) AS snippet_recall FROM prediction GROUP BY engine"""))
def _(t):
    snippets = F.array(F.substring("reference", 1, 6), F.substring("reference", 7, 5))
    return t.prediction.groupBy("engine").agg(F.round(F.avg(q.snippet_recall(snippets, F.col("prediction"))), 6).alias("snippet_recall"))


BUCKET = "CASE WHEN confidence < 0.5 THEN '0.00-0.50' WHEN confidence < 0.75 THEN '0.50-0.75' WHEN confidence < 0.9 THEN '0.75-0.90' ELSE '0.90-1.00' END"


@query("calibration", with_bindings(
    f"""SELECT e.engine, g.bucket, coalesce(samples, 0) AS samples, mean_confidence, mean_quality, exact_rate, mean_cer, ece, brier
    FROM (SELECT engine, round(sum(abs(c - k)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier FROM (SELECT engine, {BUCKET} AS bucket, sum(confidence) AS c,
        sum(1 - least(cer, 1)) AS k, count(*) AS n, sum((confidence - (1 - least(cer, 1))) ** 2) AS b FROM scored WHERE confidence IS NOT NULL GROUP BY 1, 2) GROUP BY engine) e
    JOIN (SELECT unnest(['0.00-0.50', '0.50-0.75', '0.75-0.90', '0.90-1.00']) AS bucket) g ON TRUE
    LEFT JOIN (SELECT engine, {BUCKET} AS bucket, count(*) AS samples, round(avg(confidence), 6) AS mean_confidence, round(avg(1 - least(cer, 1)), 6) AS mean_quality,
      round(avg(CAST(exact AS INTEGER)), 6) AS exact_rate, round(avg(cer), 6) AS mean_cer FROM scored WHERE confidence IS NOT NULL GROUP BY 1, 2) s
      ON s.engine = e.engine AND s.bucket = g.bucket""", SCORED))
def _(t):
    return q.calibration(q.error_rates(t.prediction))


@query("risk_coverage", with_bindings(
    """SELECT engine, share, round(any_value(take) / any_value(n), 6) AS coverage, round(avg(risk), 6) AS risk, min(confidence) AS minimum_confidence
    FROM (SELECT r.*, share, greatest(1, round_even(n * share, 0)) AS take FROM (SELECT engine, confidence, least(cer, 1) AS risk,
        row_number() OVER (PARTITION BY engine ORDER BY confidence DESC, sample_id) AS position, count(*) OVER (PARTITION BY engine) AS n FROM scored WHERE confidence IS NOT NULL) r
      JOIN (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS share) ON TRUE) WHERE position <= take GROUP BY engine, share""", SCORED))
def _(t):
    return q.risk_coverage(q.error_rates(t.prediction))


MARKS = "regexp_replace({0}, '[^0-9.,:;%/+-]', '', 'g')"


@query("recognition_slices", with_bindings(
    f"""SELECT engine, source, count(*) AS samples, round(avg(cer), 6) AS average_cer, round(avg(wer), 6) AS average_wer, round(avg(CAST(exact AS INTEGER)), 6) AS exact_rate,
    round(avg(CAST({MARKS.format('reference')} = {MARKS.format('prediction')} AS INTEGER)), 6) AS numeric_exact_rate FROM worded GROUP BY engine, source""", SCORED, WORDED))
def _(t):
    return q.recognition_slices(q.error_rates(t.prediction))


def pairs(t):
    score = lambda e: t.prediction.where(F.col("engine") == e).select(
        "sample_id", "reference", q.cer(F.col("reference"), F.col("prediction")).alias("cer"), "confidence")
    a, b = score("alpha").withColumnRenamed("cer", "champion_cer"), score("beta").drop("reference")
    joined = a.drop("confidence").join(b.withColumnRenamed("cer", "challenger_cer"), "sample_id")
    return joined.select(
        "*", (F.length("reference") / 8.0).alias("aspect_ratio"), (F.col("sample_id") % 3 == 0).alias("challenger_selected"),
        F.when(F.col("reference").rlike("[0-9]"), "amount").otherwise("general_text").alias("line_role"))


@query("champion_challenger", with_bindings(
    """SELECT slice, value, count(*) AS samples, count(*) FILTER (WHERE sel) AS selected, count(*) FILTER (WHERE b + 0.02 < a) AS wins, count(*) FILTER (WHERE a + 0.02 < b) AS regressions,
      count(*) FILTER (WHERE b - a > 0.10) AS significant_regressions, count(*) FILTER (WHERE sel AND b - a > 0.02) AS composed_regressions,
      count(*) - count(*) FILTER (WHERE b + 0.02 < a) - count(*) FILTER (WHERE a + 0.02 < b) AS ties, round(count(*) FILTER (WHERE a + 0.02 < b) / count(*), 6) AS regression_rate
    FROM (SELECT a, b, sel, unnest(['all', 'aspect', 'length', 'role']) AS slice, unnest(['all', CASE WHEN n / 8.0 < 3 THEN 'lt_3' WHEN n / 8.0 < 6 THEN '3_to_6' WHEN n / 8.0 < 10 THEN '6_to_10' ELSE 'ge_10' END,
      CASE WHEN n <= 12 THEN '01_12' WHEN n <= 24 THEN '13_24' WHEN n <= 48 THEN '25_48' ELSE '49_plus' END, role]) AS value
      FROM (SELECT length(x.reference) AS n, levenshtein(x.reference, x.prediction) / greatest(length(x.reference), 1) AS a, levenshtein(y.reference, y.prediction) / greatest(length(y.reference), 1) AS b,
        x.sample_id % 3 = 0 AS sel, CASE WHEN regexp_matches(x.reference, '[0-9]') THEN 'amount' ELSE 'general_text' END AS role
        FROM prediction x JOIN prediction y ON y.sample_id = x.sample_id WHERE x.engine = 'alpha' AND y.engine = 'beta')) GROUP BY slice, value"""))
def _(t):
    return q.champion_challenger(pairs(t))


@query("route_evidence_gate", with_bindings(
    """SELECT engine, source, samples, average_cer < 0.3 AND samples >= 30 AS accepted FROM (SELECT engine, source, count(*) AS samples, round(avg(cer), 6) AS average_cer
      FROM scored GROUP BY engine, source)""", SCORED))
def _(t):
    report = q.recognition_slices(q.error_rates(t.prediction)).select(
        "engine", "source", "samples", F.lit(0.35).alias("champion_cer"), F.when(F.col("average_cer") < 0.3, 0.1).otherwise(0.34).alias("challenger_cer"),
        F.lit(0.01).alias("regression_rate"), F.lit(0).alias("significant_regressions"), F.sha2("source", 256).alias("digest"))
    return q.route_evidence_gate(report).select("engine", "source", "samples", "accepted")


@query("checkpoint_ranking", with_bindings(
    """SELECT m.engine, round(0.35 * (1 - c) + 0.20 * 0.5 + 0.15 * 0 + 0.15 * 1 + 0.05 * x + 0.10 * (1 - w), 6) AS selection_score FROM (
      SELECT engine, round(avg(cer), 6) AS c, round(avg(CAST(exact AS INTEGER)), 6) AS x FROM scored GROUP BY engine) m
    JOIN (SELECT engine, max(c) AS w FROM (SELECT engine, source, round(avg(cer), 6) AS c FROM scored GROUP BY engine, source) GROUP BY engine) s ON s.engine = m.engine""", SCORED))
def _(t):
    scored = q.error_rates(t.prediction)
    report = scored.groupBy("engine").agg(
        F.round(F.avg("cer"), 6).alias("average_cer"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact_rate"),
    ).withColumns({"token_f1": F.lit(0.5), "special_f1": F.lit(None).cast("double"), "amount_f1": F.lit(1.5)})
    return q.checkpoint_ranking(report, q.recognition_slices(scored))


REPORT = """labels_seen AS (SELECT run, actual AS label FROM label_pair UNION SELECT run, predicted FROM label_pair),
  per_class AS (SELECT s.run, s.label, count(*) FILTER (WHERE actual = label) AS support, count(*) FILTER (WHERE predicted = label) AS guessed,
    count(*) FILTER (WHERE actual = label AND predicted = label) AS hit FROM labels_seen s JOIN label_pair p ON p.run = s.run GROUP BY s.run, s.label),
  report AS (SELECT *, hit / greatest(guessed, 1) AS p, hit / greatest(support, 1) AS r, CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit / guessed) * (hit / support) / (hit / guessed + hit / support) END AS f FROM per_class),
  overall AS (SELECT run, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(f), 6) AS macro_f1 FROM report GROUP BY run)"""


@query("classification_report", with_bindings(
    """SELECT r.run, label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, accuracy, macro_f1 FROM report r JOIN overall o ON o.run = r.run""", REPORT))
def _(t):
    return q.classification_report(t.label_pair, ["run"])


@query("classification_confusion", with_bindings("SELECT run, actual, predicted, count(*) AS count FROM label_pair GROUP BY ALL"))
def _(t):
    return q.confusion_rows(t.label_pair, ["run"])


@query("seed_regression", with_bindings(
    """SELECT count(*) AS runs, round(avg(accuracy), 6) AS mean_accuracy, min(accuracy) AS min_accuracy, round(avg(macro_f1), 6) AS mean_macro_f1, min(macro_f1) AS min_macro_f1,
    min(accuracy) >= 0.65 AND min(macro_f1) >= 0.65 AS passed FROM overall""", REPORT))
def _(t):
    return q.seed_regression(q.classification_report(t.label_pair, ["run"]))


@query("class_metrics", with_bindings(
    """SELECT l.run, count(*) FILTER (WHERE actual IN ('q11', 'q01')) AS subset_support, round(avg(CAST(actual = predicted AS INTEGER)) FILTER (WHERE actual IN ('q11', 'q01')), 6) AS subset_top1, round(avg(CAST(actual = predicted AS INTEGER)), 6) AS top1, round(avg(CAST(actual = predicted OR actual IN ('q10', 'q00') AS INTEGER)), 6) AS top3, any_value(macro_f1) AS macro_f1
    FROM label_pair l JOIN overall o ON o.run = l.run GROUP BY l.run""", REPORT))
def _(t):
    return q.class_metrics(t.label_pair.withColumn("candidates", F.array("predicted", F.lit("q10"), F.lit("q00"), F.lit("q01"))), ("q11", "q01"))


def runs(t):
    """Extracted texts as several engine runs of one document."""
    return extracted(t).withColumn("run_order", F.col("doc_id") % 4).withColumn("doc_id", F.floor(F.col("doc_id") / 4))


RUNS = """runs AS (SELECT CAST(floor(w.doc_id / 4.0) AS BIGINT) AS doc_id, w.doc_id % 4 AS run_order, w.engine, w.confidence, w.merchant, w.date, w.total_minor, w.currency, w.subtotal_minor,
      w.tax_minor, w.discount_minor, w.payment_method, w.field_confidence, r.readiness, coalesce(c, 0) AS crit, coalesce(n, 0) AS warn, coalesce(codes, '') AS codes
    FROM judged w JOIN ready r ON r.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE issue LIKE '%:critical') AS c, count(*) FILTER (WHERE issue LIKE '%:warning') AS n,
      string_agg(issue, ',') AS codes FROM issue GROUP BY doc_id) i ON i.doc_id = w.doc_id)"""


@query("engine_selection", with_bindings(
    """SELECT doc_id, arg_max(engine, (score, -run_order)) AS selected_engine, max(score) AS score, arg_max(CASE WHEN miss = '' THEN 'selected-by-extraction-readiness-and-ocr-confidence'
      ELSE 'selected-with-review-needed-missing:' || miss END, (score, -run_order)) AS reason, round(avg(confidence), 4) AS average_confidence, count(*) AS runs
    FROM (SELECT *, floor(greatest(0, least(1, round(confidence * 0.36 + readiness * 0.64 - least(0.72, crit * 0.22 + warn * 0.04), 9))) * 10000 + 0.5) / 10000.0 AS score,
      concat_ws(',', CASE WHEN total_minor IS NULL THEN 'total' END, CASE WHEN date IS NULL THEN 'date' END, CASE WHEN merchant IS NULL THEN 'merchantName' END) AS miss FROM runs) GROUP BY doc_id""",
    *ALL, EVIDENCE, ISSUES, READY, RUNS))
def _(t):
    return q.engine_selection(runs(t))


@query("field_fusion")
def _(t):
    return q.field_fusion(runs(t))


@query("pairwise_similarity")
def _(t):
    text = t.receipt.select("doc_id", "engine", "text")
    noisy = text.select("doc_id", F.lit("ENSEMBLE").alias("engine"), F.translate("text", "0AE", "O4").alias("text"))
    return q.pairwise_similarity(text.unionByName(noisy))


@query("attempt_selection", with_bindings(
    f"""SELECT doc_id, page, arg_max(attempt_id, (score, -attempt_id)) AS attempt_id, max(score) AS score, arg_max(score >= 0.58 AND size >= 12, (score, -attempt_id)) AS good, count(*) AS attempts
    FROM (SELECT CAST(floor(doc_id / 3.0) AS BIGINT) AS doc_id, CAST(v % 2 AS BIGINT) AS page, doc_id AS attempt_id, length(trim(text)) AS size,
      round(CAST(least(1, confidence * 0.7 + least(length(trim(text)) / 500.0, 1.0) * 0.2 + least({' + '.join(f"CASE WHEN contains(lower(text), '{w}') THEN 0.04::DOUBLE ELSE 0 END" for w in q.ATTEMPT_WORDS)}, 0.2)) AS DOUBLE), 6) AS score
      FROM receipt) GROUP BY doc_id, page"""))
def _(t):
    rows = t.receipt.select(F.floor(F.col("doc_id") / 3).alias("doc_id"), (F.col("v") % 2).alias("page"),
                            F.col("doc_id").alias("attempt_id"), "text", "confidence")
    return q.attempt_selection(rows)


@query("extraction_gate", with_bindings(
    """SELECT doc_id, CASE WHEN engine <> 'CUSTOM_CRNN' THEN NULL WHEN v = 0 THEN 'CUSTOM_OCR_LOW_CONFIDENCE' WHEN v = 3 THEN 'CUSTOM_OCR_SEGMENTATION_SUSPECT' WHEN v = 6 THEN 'CUSTOM_OCR_REVIEW_REQUIRED'
      WHEN doc_id % 5 > 0 THEN 'CUSTOM_OCR_REQUIRES_REVIEW' END AS skip_reason FROM receipt"""))
def _(t):
    warnings = F.when(F.col("v") == 0, F.array(F.lit("CUSTOM_OCR_SEGMENTATION_SUSPECT"), F.lit("CUSTOM_OCR_LOW_CONFIDENCE"))).when(
        F.col("v") == 3, F.array(F.lit("CUSTOM_OCR_SEGMENTATION_SUSPECT"))).otherwise(F.array().cast("array<string>"))
    rows = t.receipt.select("doc_id", "engine", warnings.alias("warnings"),
                            F.when(F.col("v") != 6, F.col("doc_id") % 5).alias("critical_issues"))
    return q.extraction_gate(rows)


@query("calibrated_confidence", with_bindings(
    """SELECT doc_id, round_even(confidence * reliability * page, 4) AS calibrated FROM (SELECT doc_id, confidence, CASE v % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.25 WHEN 2 THEN 0.62 ELSE 1 END AS reliability,
      round_even(CASE WHEN v = 3 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN v >= 8 THEN 0.8::DOUBLE ELSE 1 END, 4) AS page FROM receipt)"""))
def _(t):
    run = t.receipt.select("doc_id", "confidence", (F.col("v") % 4).alias("model_id"), F.when(F.col("v") == 3, "blurred").otherwise("ok").alias("page_status"),
                           F.when(F.col("v") >= 8, -2.5).otherwise(1.0).alias("skew"), F.lit(0.1).alias("density"))
    model = t.receipt.groupBy((F.col("v") % 4).alias("model_id")).agg(F.count(F.lit(1)).alias("n")).where("model_id < 3").select(
        "model_id", F.element_at(F.array(F.lit(0.1), F.lit(0.9), F.lit(0.38)), (F.col("model_id") + 1).cast("int")).alias("validation_cer"))
    return q.calibrated_confidence(run, model).select("doc_id", "calibrated")
