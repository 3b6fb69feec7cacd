"""Scoring of recognised documents: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarking as b, quality
from .bindings import with_bindings
from .registry import query

TRUTH = (("merchant", "t_merchant"), ("date", "t_date"), ("total", "t_total"), ("tax", "t_tax"), ("subtotal", "t_subtotal"), ("documentType", "document_type"), ("paymentMethod", "t_payment"))


def runs(scan_run):
    """Runs of the engines with truth as maps and arrays on the row."""
    item = lambda k: F.when(F.col(f"item{k}").isNotNull(), F.struct(F.col(f"item{k}").alias("description"), F.col(f"amount{k}").alias("amount")))
    items = F.filter(F.array(item(1), item(2)), lambda i: i.isNotNull())
    present = lambda *c: F.filter(F.array(*[F.col(x) for x in c]), lambda x: x.isNotNull())
    return scan_run.select(
        "sample_id", "engine", "v", "reference", "prediction", "document_type", "confidence", "latency_ms", "error_code",
        F.create_map(*[x for name, c in TRUTH for x in (F.lit(name), F.col(c))]).alias("fields"), present("t_merchant", "t_total").alias("snippets"),
        items.alias("line_items"), F.transform(items, lambda i: i["amount"]).alias("line_item_amounts"),
        F.filter(F.split("warnings", ","), lambda w: w != "").alias("warning_codes"),
    )


def scored(t):
    return b.benchmark_rows(runs(t.scan_run), ("sample_id", "engine", "v"))


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(upper({x}), '₺', ' TL '), 'TRY', ' TL '), '\\s+', ' ', 'g'))"


def word(x: str, words: str) -> str:
    return f"regexp_matches({x}, '(?:^|{b.EDGE})(?:{words})(?:{b.EDGE}|$)')"


def any_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def amounts(x: str) -> str:
    found = f"regexp_extract_all({x}, '{quality.AMOUNT}')"
    return f"list_distinct(list_filter(list_transform({found}, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: x <> ''))"


def extractor(source: str, hint: str) -> tuple[str, ...]:
    """Common table expressions over ``source`` (key, text): text lines, fields and items by key."""
    minor = lambda c: f"coalesce(TRY_CAST({c} AS DECIMAL(38, 0)), 0)"
    last = lambda label, more="": f"arg_max(amount, i) FILTER (WHERE amount IS NOT NULL AND {word('n', label)}{more})"
    parts = f"{minor('subtotal')} + {minor('tax')} - {minor('discount')}"
    return (
        f"""src_lines AS (SELECT key, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT key,
          list_filter(list_transform(regexp_split_to_array(text, '{b.SEPARATORS}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM {source}))""",
        f"""src_values AS (SELECT *, {norm('l')} AS n, list_sort(list_transform({amounts('l')}, lambda a: lpad(CAST(length(a) AS VARCHAR), 6, '0') || a), 'DESC')[1][7:] AS amount,
          nullif(trim(regexp_extract(l, '(?i){b.SELLER}', 1)), '') AS seller FROM src_lines)""",
        f"""src_found AS (SELECT key, {last(b.TAX_LABEL)} AS tax, {last(b.SUBTOTAL_LABEL)} AS subtotal, {last(b.DISCOUNT_LABEL)} AS discount,
          {last(b.TOTAL_LABEL, f" AND NOT {word('n', b.NOT_TOTAL_LABEL)}")} AS total, arg_min(seller, i) FILTER (WHERE seller IS NOT NULL) AS seller,
          arg_min(l, i) FILTER (WHERE i <= 5 AND length(regexp_replace(l, '[^\\p{{L}}]', '', 'g')) >= 3 AND NOT {word('n', b.HEADER_WORDS)}) AS heading FROM src_values GROUP BY key)""",
        f"""src_whole AS (SELECT key, {hint} AS hint, {norm('text')} AS n, regexp_matches(text, '(?i){b.CURRENCY}') AS lira,
          regexp_extract(text, '{b.DATE}', ['d', 'm', 'y']) AS day FROM {source})""",
        f"""src_fields AS (SELECT w.key, CASE WHEN day.d <> '' THEN CASE WHEN length(day.y) = 2 THEN '20' || day.y ELSE lpad(day.y, 4, '0') END || '-' || lpad(day.m, 2, '0') || '-' || lpad(day.d, 2, '0') END AS date,
          CASE WHEN lira THEN 'TRY' END AS currency, CASE WHEN {any_of('n', b.INVOICE_WORDS)} THEN 'invoice' WHEN {any_of('n', b.RECEIPT_WORDS)} THEN 'receipt' ELSE hint END AS "documentType",
          CASE WHEN {any_of('n', b.CARD_WORDS)} THEN 'KART' WHEN {any_of('n', b.CASH_WORDS)} THEN 'NAKIT' END AS "paymentMethod", tax, subtotal, discount,
          CASE WHEN {minor('subtotal')} > 0 AND {minor('tax')} > 0 AND {parts} > {minor('subtotal')} AND {minor('total')} <= {minor('subtotal')} THEN CAST({parts} AS VARCHAR) ELSE total END AS total,
          coalesce(seller, heading) AS merchant FROM src_whole w LEFT JOIN src_found USING (key))""",
        f"""src_marked AS (SELECT key, i, string_split(regexp_replace(l, '(?i)(^|[^%0-9])({b.ITEM_AMOUNT})', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)) AS p FROM src_lines
          WHERE NOT regexp_matches(l, '(?i){b.NOT_ITEM}'))""",
        f"""src_items AS (SELECT * FROM (SELECT key, i, trim(regexp_replace(trim(CASE WHEN len(p) > 2 AND regexp_matches(p[1], '(?i){b.QUANTITY}') THEN regexp_replace(p[1], '(?i){b.QUANTITY}', '')
          ELSE replace(array_to_string(p[:-2], ''), chr(2), '') END), '{b.RATE_TAIL}', ''), ' -:') AS description,
          regexp_replace(string_split(p[-1], chr(2))[1], '[^0-9]', '', 'g') AS amount FROM src_marked WHERE len(p) > 1) WHERE length(description) >= 2)""",
    )


EVAL = extractor("(SELECT doc_id AS key, text FROM ocr_text)", "CAST(NULL AS VARCHAR)")


@query("structured_fields_eval", with_bindings("SELECT key AS doc_id, * EXCLUDE (key) FROM src_fields", *EVAL))
def _(t):
    return b.structured_fields(t.ocr_text, keep=("doc_id",))


@query("scored_line_items", with_bindings("SELECT key AS doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS INTEGER) AS pos, description, amount FROM src_items", *EVAL))
def _(t):
    found = t.ocr_text.select("doc_id", F.posexplode(b.scored_items(F.col("text"))).alias("pos", "item"))
    return found.select("doc_id", "pos", "item.*")


ASCII = "translate({0}, 'üÜıÇçğĞİöÖşŞ', '~^`{{}}<>@\\[]_#')"
DISTANCE = "levenshtein(" + ASCII.format("reference") + ", " + ASCII.format("trim(prediction)") + ") / greatest(length(reference), 1)"
SPLIT = "list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda w: w <> '')"
CODED = "array_to_string(list_transform({0}, lambda w: chr(CAST(32 + list_position(known, w) AS INTEGER))), '')"
SETS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
CANDIDATES = """CASE WHEN field = 'date' AND len(string_split(want, '-')) = 3 THEN [want, string_split(want, '-')[3] || '.' || string_split(want, '-')[2] || '.' || string_split(want, '-')[1],
    string_split(want, '-')[3] || '/' || string_split(want, '-')[2] || '/' || string_split(want, '-')[1]] WHEN field = 'documentType' AND lower(want) = 'receipt' THEN [want, 'FIS', 'FİŞ', 'FIŞ', 'FİS']
    WHEN field = 'documentType' AND lower(want) = 'invoice' THEN [want, 'FATURA', 'E-ARŞİV', 'E-ARSIV'] ELSE [want] END"""


def bag(x: str, letters: str) -> str:
    return f"length(regexp_replace({x}, '[^{letters}]', '', 'g'))"


def prf(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p, r = f"{tp} / greatest({tp} + {fp}, 1)", f"{tp} / greatest({tp} + {fn}, 1)"
    judge = lambda x: f"CASE WHEN {tp} + {fp} + {fn} > 0 THEN {x} END"
    return judge(p), judge(r), judge(f"CASE WHEN {tp} = 0 THEN 0 ELSE 2 * ({p}) * ({r}) / ({p} + {r}) END")


S = quality.SPECIAL_LETTERS
HITS = " + ".join(f"least({bag('reference', c)}, {bag('prediction', c)})" for c in S)
FP, FR, FF = prf("tp", "fp", "fn")
ROWS = (
    "good AS (SELECT *, sample_id || '|' || engine AS key FROM scan_run WHERE error_code IS NULL)",
    *extractor("(SELECT key, prediction AS text, document_type FROM good)", "CASE WHEN document_type NOT IN ('', 'unknown') THEN document_type END"),
    f"""field_rows AS (SELECT *, CASE WHEN trim(coalesce(want, '')) = '' THEN 0 ELSE CAST(hit AS INTEGER) END AS tp,
      CASE WHEN trim(coalesce(want, '')) = '' THEN CAST(coalesce(got, '') <> '' AS INTEGER) ELSE CAST(got IS NOT NULL AND NOT hit AS INTEGER) END AS fp,
      CASE WHEN trim(coalesce(want, '')) = '' THEN 0 ELSE CAST(NOT hit AS INTEGER) END AS fn FROM (
      SELECT *, coalesce(CASE WHEN field IN ('total', 'tax', 'subtotal', 'discount') THEN regexp_replace(want, '[^0-9]', '', 'g') = regexp_replace(got, '[^0-9]', '', 'g')
        ELSE len(list_filter({CANDIDATES}, lambda c: {norm('got')} = {norm('c')} OR ({norm('c')} <> '' AND contains({norm('got')}, {norm('c')})))) > 0 END, false) AS hit FROM (
        {' UNION ALL '.join(f"SELECT g.key, engine, v, '{name}' AS field, g.{c} AS want, f.{chr(34) + name + chr(34)} AS got FROM good g JOIN src_fields f ON f.key = g.key" for name, c in TRUTH)})))""",
    f"""wanted AS (SELECT key, d, a, sum(e) AS e, sum(p) AS p FROM (
      SELECT key, {norm('description')} AS d, amount AS a, 0 AS e, 1 AS p FROM src_items
      UNION ALL SELECT key, {norm('item1')}, regexp_replace(amount1, '[^0-9]', '', 'g'), 1, 0 FROM good WHERE item1 IS NOT NULL
      UNION ALL SELECT key, {norm('item2')}, regexp_replace(amount2, '[^0-9]', '', 'g'), 1, 0 FROM good WHERE item2 IS NOT NULL) GROUP BY key, d, a)""",
    """item_rows AS (SELECT key, sum(least(e, p)) AS itp, sum(p) - sum(least(e, p)) AS ifp, sum(e) - sum(least(e, p)) AS ifn FROM wanted GROUP BY key HAVING sum(e) > 0)""",
    f"""row_scores AS (SELECT *, {DISTANCE} AS cer, levenshtein({CODED.format('rw')}, {CODED.format('hw')}) / greatest(len(rw), 1) AS wer,
      len(list_intersect(ts, hs)) / greatest(len(hs), 1) AS tp_, len(list_intersect(ts, hs)) / greatest(len(ts), 1) AS tr_,
      CASE WHEN {bag('reference', S)} + {bag('prediction', S)} = 0 THEN 1 ELSE ({HITS}) / greatest({bag('prediction', S)}, 1) END AS sp_,
      CASE WHEN {bag('reference', S)} + {bag('prediction', S)} = 0 THEN 1 ELSE ({HITS}) / greatest({bag('reference', S)}, 1) END AS sr_,
      CASE WHEN len(ra) + len(ha) > 0 THEN len(list_intersect(ra, ha)) / greatest(len(ha), 1) END AS ap_, CASE WHEN len(ra) + len(ha) > 0 THEN len(list_intersect(ra, ha)) / greatest(len(ra), 1) END AS ar_,
      CASE WHEN len(snips) > 0 THEN len(list_filter(snips, lambda s: contains(said, {norm('s')}))) / len(snips) END AS sn_,
      CASE WHEN len(ia) > 0 THEN len(list_filter(ia, lambda s: contains(regexp_replace(said, '[^0-9]', '', 'g'), s))) / len(ia) END AS ia_ FROM (
      SELECT *, list_distinct(list_concat(rw, hw)) AS known FROM (SELECT *, {SPLIT.format('reference')} AS rw, {SPLIT.format('trim(prediction)')} AS hw, {SETS.format(norm('reference'))} AS ts, {SETS.format(norm('prediction'))} AS hs,
        {amounts('reference')} AS ra, {amounts('prediction')} AS ha, {norm('prediction')} AS said, list_filter([t_merchant, t_total], lambda s: s IS NOT NULL) AS snips,
        list_filter([CASE WHEN item1 IS NOT NULL THEN regexp_replace(amount1, '[^0-9]', '', 'g') END, CASE WHEN item2 IS NOT NULL THEN regexp_replace(amount2, '[^0-9]', '', 'g') END], lambda s: s IS NOT NULL) AS ia FROM good)))""",
)
F1 = "avg(CASE WHEN {0} IS NULL THEN NULL WHEN {0} + {1} = 0 THEN 0 ELSE 2 * {0} * {1} / ({0} + {1}) END)"
IP, IR, IF_ = prf("sum(itp)", "sum(ifp)", "sum(ifn)")
REPORT = (
    *ROWS,
    f"field_sums AS (SELECT engine, field, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM field_rows GROUP BY engine, field HAVING sum(tp) + sum(fp) + sum(fn) > 0)",
    f"field_scored AS (SELECT *, {FP} AS precision, {FR} AS recall, {FF} AS f1 FROM field_sums)",
    f"""field_all AS (SELECT engine, field_tp, field_fp, field_fn, {', '.join(f'{x} AS field_{n}' for x, n in zip(prf('field_tp', 'field_fp', 'field_fn'), ('precision', 'recall', 'f1')))}, field_macro_precision, field_macro_recall, field_macro_f1 FROM (
      SELECT engine, sum(tp) AS field_tp, sum(fp) AS field_fp, sum(fn) AS field_fn, avg(precision) AS field_macro_precision, avg(recall) AS field_macro_recall, avg(f1) AS field_macro_f1 FROM field_scored GROUP BY engine))""",
    """calibrated AS (SELECT engine, sum(abs(c - k)) / sum(n) AS ece, sum(b) / sum(n) AS brier FROM (SELECT engine, CASE WHEN confidence < 0.5 THEN 1 WHEN confidence < 0.75 THEN 2 WHEN confidence < 0.9 THEN 3 ELSE 4 END AS bucket,
      sum(confidence) AS c, sum(1 - least(cer, 1)) AS k, count(*) AS n, sum((confidence - (1 - least(cer, 1))) ** 2) AS b FROM row_scores WHERE confidence IS NOT NULL GROUP BY 1, 2) GROUP BY engine)""",
    """warned AS (SELECT engine, string_agg(code || '=' || n, ',' ORDER BY code || '=' || n) AS warning_counts FROM (
      SELECT engine, code, count(*) AS n FROM (SELECT engine, unnest(string_split(warnings, ',')) AS code FROM good) WHERE code <> '' GROUP BY engine, code) GROUP BY engine)""",
    f"""means AS (SELECT engine, avg(cer) AS average_cer, avg(wer) AS average_wer, avg(sn_) AS snippet_recall, avg(tp_) AS token_precision, avg(tr_) AS token_recall, {F1.format('tp_', 'tr_')} AS token_f1,
      avg(sp_) AS special_precision, avg(sr_) AS special_recall, {F1.format('sp_', 'sr_')} AS special_f1, avg(ap_) AS amount_precision, avg(ar_) AS amount_recall, {F1.format('ap_', 'ar_')} AS amount_f1,
      avg(ia_) AS line_item_amount_recall, avg(confidence) AS average_confidence, avg(latency_ms) AS average_latency_ms, sum(itp) AS line_item_tp, sum(ifp) AS line_item_fp, sum(ifn) AS line_item_fn,
      CASE WHEN count(itp) > 0 THEN coalesce({IP}, 0) END AS line_item_precision, CASE WHEN count(itp) > 0 THEN coalesce({IR}, 0) END AS line_item_recall, CASE WHEN count(itp) > 0 THEN coalesce({IF_}, 0) END AS line_item_f1,
      count(*) FILTER (WHERE confidence >= 0.75 AND (cer > 0.5 OR coalesce(sn_ < 0.4, false))) AS high_confidence_wrong FROM row_scores LEFT JOIN item_rows USING (key) GROUP BY engine)""",
    """report AS (SELECT a.engine, attempted, succeeded, failed, failed / attempted AS failure_rate, failure_codes, CASE WHEN succeeded > 0 THEN 'ok' ELSE 'failed' END AS status,
      CAST(coalesce(field_tp, 0) AS BIGINT) AS field_tp, CAST(coalesce(field_fp, 0) AS BIGINT) AS field_fp, CAST(coalesce(field_fn, 0) AS BIGINT) AS field_fn,
      CAST(coalesce(line_item_tp, 0) AS BIGINT) AS line_item_tp, CAST(coalesce(line_item_fp, 0) AS BIGINT) AS line_item_fp, CAST(coalesce(line_item_fn, 0) AS BIGINT) AS line_item_fn,
      coalesce(high_confidence_wrong, 0) AS high_confidence_wrong, coalesce(warning_counts, '') AS warning_counts,
      * EXCLUDE (engine, attempted, succeeded, failed, failure_codes, field_tp, field_fp, field_fn, line_item_tp, line_item_fp, line_item_fn, high_confidence_wrong, warning_counts)
      FROM (SELECT engine, count(*) AS attempted, count(*) FILTER (WHERE error_code IS NULL) AS succeeded, count(*) FILTER (WHERE error_code IS NOT NULL) AS failed,
        coalesce(string_agg(DISTINCT error_code, ',' ORDER BY error_code), '') AS failure_codes FROM scan_run GROUP BY engine) a
      LEFT JOIN means USING (engine) LEFT JOIN field_all USING (engine) LEFT JOIN calibrated USING (engine) LEFT JOIN warned USING (engine))""",
)


@query("engine_summary", with_bindings("SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in (
    "failure_rate", "average_cer", "average_wer", "snippet_recall", "token_precision", "token_recall", "token_f1", "special_precision", "special_recall", "special_f1", "amount_precision", "amount_recall", "amount_f1",
    "line_item_amount_recall", "average_confidence", "average_latency_ms", "line_item_precision", "line_item_recall", "line_item_f1", "field_precision", "field_recall", "field_f1",
    "field_macro_precision", "field_macro_recall", "field_macro_f1", "ece", "brier")) + ") FROM report", *REPORT))
def _(t):
    return rounded(b.engine_report(scored(t)))


@query("quality_gate", with_bindings(
    "SELECT engine, reasons = '' AS passed, reasons FROM (SELECT engine, concat_ws(',', CASE WHEN succeeded = 0 THEN 'ENGINE_NOT_OK' END, "
    + ", ".join(f"CASE WHEN {c + ' IS NULL OR ' if c == 'average_cer' else ''}{c} {sign} {limit} THEN '{code}' END" for c, sign, limit, code in quality.GATE) + ") AS reasons FROM report)", *REPORT))
def _(t):
    return quality.quality_gate(b.engine_report(scored(t))).withColumn("reasons", F.array_join("reasons", ","))


@query("field_scores", with_bindings("SELECT engine, field, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM field_scored", *REPORT))
def _(t):
    return rounded(b.field_report(scored(t)))


@query("field_accuracy_by_variant", with_bindings(
    """SELECT v, field, CAST(samples AS BIGINT) AS samples, CAST(hits AS BIGINT) AS hits, round(hits / samples, 6) AS accuracy, rows, average_cer, average_wer FROM (
      SELECT v, field, sum(tp + fn) AS samples, sum(tp) AS hits FROM field_rows WHERE tp + fn > 0 GROUP BY v, field)
    JOIN (SELECT v, count(*) AS rows, round(avg(cer), 6) AS average_cer, round(avg(wer), 6) AS average_wer FROM row_scores GROUP BY v) USING (v)""", *ROWS))
def _(t):
    return rounded(b.accuracy_by_variant(scored(t), "v"))


@query("reference_text_extraction", with_bindings(
    """SELECT field, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM field_rows GROUP BY field HAVING sum(tp) + sum(fp) + sum(fn) > 0""",
    "good AS (SELECT *, doc_id AS key, 'reference' AS engine, reference AS prediction FROM scan)", *ROWS[1:10]))
def _(t):
    """What the scoring extractor finds in the reference texts themselves: the ceiling of every engine."""
    own = t.scan.withColumns({"sample_id": F.col("doc_id"), "engine": F.lit("reference"), "prediction": F.col("reference"), "warnings": F.lit(""), "confidence": F.lit(1.0),
                              "latency_ms": F.lit(0).cast("long"), "error_code": F.lit(None).cast("string")})
    return b.field_report(b.benchmark_rows(runs(own))).select("field", "tp", "fp", "fn")
