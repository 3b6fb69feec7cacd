"""Curation: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as cu
from .bindings import with_bindings
from .registry import query

USABLE = "usable AS (SELECT * FROM manifest WHERE usable_for_training AND trim(image) <> '')"


@query("usable_rows", with_bindings("SELECT id, source, image, split FROM usable WHERE source IN ('src1', 'src2')", USABLE))
def _(t):
    return cu.usable_rows(t.manifest, ("src1", "src2")).select("id", "source", "image", "split")


@query("label_filters", with_bindings(
    """SELECT id, text FROM manifest WHERE length(text) BETWEEN 2 AND 140 AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 2 AND box_w <> 3"""))
def _(t):
    one = F.lit(1)
    box = F.when(F.col("box_w") == 3, F.array(one, one)).otherwise(F.array(one, one, one, one))
    return cu.label_filters(t.manifest.withColumn("box", box)).select("id", "text")


CONFUSABLE = "length(regexp_replace(text, '[^Iİıil1OÖ0SŞ5GĞcçuü,.;:₺]', '', 'g')) >= 2"


@query("confusable_lines", with_bindings(f"SELECT id FROM manifest WHERE {CONFUSABLE}"))
def _(t):
    return cu.confusable_lines(t.manifest).select("id")


def fielded(t):
    keys = F.when(F.col("id") % 19 == 0, F.array(F.lit("category"), F.lit("x"))).otherwise(F.array(F.lit("merchant")))
    return t.manifest.withColumn("field_keys", keys)


AMOUNT = r"(?i)(?:[0-9]{1,3}(?:[. ][0-9]{3})*|[0-9]+)[,.][0-9]{2}(?:\s*(?:TL|TRY|₺|EUR|€|USD|\$))?"
MINED = f"""mined AS (SELECT CAST(id AS VARCHAR) || ':hardcase' AS id, source, split, image, text, reasons, CAST(least(4, 1 + len(reasons) // 2) AS INTEGER) AS weight FROM (
    SELECT *, list_sort(list_filter([CASE WHEN regexp_matches(text, '[{cu.SPECIAL_LETTERS}]') THEN 'turkish_special_character' END,
      CASE WHEN regexp_matches(text, '{AMOUNT}') THEN 'amount_or_decimal_comma' END, CASE WHEN regexp_matches(text, '{cu.DATE_ONLY}') THEN 'date_pattern' END,
      CASE WHEN regexp_matches(text, '{cu.FIELD_WORDS}') THEN 'field_keyword' END, CASE WHEN {CONFUSABLE} THEN 'hard_character_confusion' END,
      CASE WHEN id % 19 = 0 THEN 'layout_or_extraction_field' END], lambda x: x IS NOT NULL)) AS reasons FROM usable) WHERE len(reasons) > 0)"""


@query("hardcase_mining", with_bindings("SELECT id, source, split, text, array_to_string(reasons, ',') AS reasons, weight FROM mined", USABLE, MINED))
def _(t):
    return cu.hardcase_mining(fielded(t)).withColumn("reasons", F.array_join("reasons", ","))


@query("hardcase_reason_counts", with_bindings("SELECT unnest(reasons) AS reason, count(*) AS count FROM mined GROUP BY 1", USABLE, MINED))
def _(t):
    return cu.reason_counts(cu.hardcase_mining(fielded(t)))


KEY = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query("hardcase_merge", with_bindings(
    f"""SELECT source, split, image, crop, {KEY} AS text_key, coalesce(array_to_string(list_sort(list_distinct(flatten(list(r)))), ','), '') AS reasons,
      CAST(greatest(1, least(4, max(w))) AS INTEGER) AS weight FROM (
      SELECT source, split, image, CASE WHEN box_w > 0 THEN box_w END AS crop, text, ['base'] AS r, hardcase_weight AS w FROM usable UNION ALL SELECT m.source, m.split, m.image, CASE WHEN u.box_w > 0 THEN u.box_w END, m.text, reasons, weight
      FROM mined m JOIN usable u ON m.id = CAST(u.id AS VARCHAR) || ':hardcase') GROUP BY 1, 2, 3, 4, 5""",
    USABLE, MINED))
def _(t):
    columns = ["source", "split", "image", "crop", "text", "reasons", "weight"]
    usable = cu.usable_rows(fielded(t)).withColumn("crop", F.when(F.col("box_w") > 0, F.col("box_w")))
    base = usable.select("source", "split", "image", "crop", "text", F.array(F.lit("base")).alias("reasons"), F.col("hardcase_weight").alias("weight"))
    mined = cu.hardcase_mining(fielded(t)).select(F.regexp_extract("id", "^[0-9]+", 0).cast("long").alias("k"), "reasons", "weight")
    mined = mined.join(usable.select(F.col("id").alias("k"), "source", "split", "image", "crop", "text"), "k").select(*columns)
    return cu.hardcase_merge(base, mined).withColumn("reasons", F.array_join("reasons", ","))


WEIGHTS = {"src1": 1.5, "src2": 0.5}
LABELLED = f"""labelled AS (SELECT id, source, hardcase_weight, CASE WHEN len(l) = 0 THEN ['general_text'] ELSE l END AS labels FROM (SELECT *, list_sort(list_filter([
      CASE WHEN regexp_matches(upper(text), '^(FİŞ NO|FATURA NO|VKN |TARİH |ARA TOPLAM |KDV |TOPLAM )') THEN 'key_field' END, CASE WHEN regexp_matches(text, '{AMOUNT}') THEN 'amount' END,
      CASE WHEN regexp_matches(text, '{cu.DATE_OR_TIME}') THEN 'date_or_time' END, CASE WHEN regexp_matches(text, '{cu.IDENTIFIER}') THEN 'identifier' END,
      CASE WHEN regexp_matches(text, '[{cu.SPECIAL_LETTERS_LINE}]') THEN 'turkish_special' END, CASE WHEN length(text) > 40 THEN 'long_line' END,
      CASE WHEN id % 3 = 0 THEN 'hardcase' END], lambda x: x IS NOT NULL)) AS l FROM manifest)),
  weighted AS (SELECT *, round(least(8, greatest(1, (CASE source WHEN 'src1' THEN 1.5::DOUBLE WHEN 'src2' THEN 0.5 ELSE 1 END)
      * {' * '.join(f"(CASE WHEN list_contains(labels, '{k}') THEN {v}::DOUBLE ELSE 1 END)" for k, v in cu.TASK_WEIGHTS.items())}
      * (CASE WHEN list_contains(labels, 'hardcase') THEN greatest(1, least(4, hardcase_weight)) ELSE 1 END))), 6) AS weight FROM labelled)"""


def weighted(t):
    rows = t.manifest.withColumn("reasons", F.when(F.col("id") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return cu.sampling_weights(rows, WEIGHTS)


@query("sampling_weights", with_bindings("SELECT id, array_to_string(labels, ',') AS labels, weight FROM weighted", LABELLED))
def _(t):
    return weighted(t).select("id", F.array_join("labels", ",").alias("labels"), "weight")


@query("weighted_shares", with_bindings(
    """SELECT 'source' AS kind, source AS value, round(sum(weight) / (SELECT sum(weight) FROM weighted), 6) AS share FROM weighted GROUP BY source
    UNION ALL SELECT 'task', l, round(sum(weight) / (SELECT sum(weight) FROM weighted), 6) FROM (SELECT unnest(labels) AS l, weight FROM weighted) GROUP BY l""", LABELLED))
def _(t):
    return cu.weighted_shares(weighted(t))


@query("dataset_mix", with_bindings(
    """SELECT 'source' AS kind, source AS value, count(*) AS count FROM manifest GROUP BY 2 UNION ALL SELECT 'split', split, count(*) FROM manifest GROUP BY 2
    UNION ALL SELECT 'document_type', CASE WHEN id % 3 = 0 THEN 'receipt' ELSE 'unknown' END, count(*) FROM manifest GROUP BY 2 UNION ALL SELECT 'level', CASE WHEN id % 5 = 0 THEN 'document' ELSE 'line' END, count(*) FROM manifest GROUP BY 2
    UNION ALL SELECT 'labels', l, count(*) FROM (SELECT unnest(labels) AS l FROM labelled) GROUP BY 2 UNION ALL SELECT 'reasons', 'x', count(*) FROM manifest WHERE id % 3 = 0""", LABELLED))
def _(t):
    rows = weighted(t).withColumns({"document_type": F.when(F.col("id") % 3 == 0, "receipt"), "level": F.when(F.col("id") % 5 == 0, "document").otherwise("line")})
    return cu.dataset_mix(rows)


@query("bounded_split_sample", with_bindings(
    """SELECT id, split, CASE WHEN rn <= quota THEN 'quota' ELSE 'overflow' END AS reason FROM (
      SELECT *, row_number() OVER (PARTITION BY split, rn > quota ORDER BY h, id) AS spare, sum(CASE WHEN rn <= quota THEN 1 ELSE 0 END) OVER (PARTITION BY split) AS taken FROM (
        SELECT m.*, target, row_number() OVER (PARTITION BY m.split, m.source ORDER BY h, id) AS rn, target // n + CASE WHEN i <= target % n THEN 1 ELSE 0 END AS quota
        FROM (SELECT id, source, split, sha256('row:7:' || CAST(id AS VARCHAR)) AS h, CASE split WHEN 'train' THEN 510 ELSE 90 END AS target FROM manifest) m
        JOIN (SELECT split, source, row_number() OVER (PARTITION BY split ORDER BY source) AS i, count(*) OVER (PARTITION BY split) AS n FROM (SELECT DISTINCT split, source FROM manifest)) s ON s.source = m.source AND s.split = m.split))
    WHERE rn <= quota OR spare <= target - taken"""))
def _(t):
    return cu.bounded_split_sample(t.manifest.select("id", "source", "split"), 600, 7).select("id", "split", "reason")


@query("source_balanced_sample", with_bindings(
    """SELECT id, source, CASE WHEN rn <= quota THEN 'quota' ELSE 'overflow' END AS reason FROM (
      SELECT *, row_number() OVER (PARTITION BY rn > quota ORDER BY h, id) AS spare, sum(CASE WHEN rn <= quota THEN 1 ELSE 0 END) OVER () AS taken FROM (
        SELECT m.*, row_number() OVER (PARTITION BY m.source ORDER BY h, id) AS rn, 2000 // n + CASE WHEN i <= 2000 % n THEN 1 ELSE 0 END AS quota
        FROM (SELECT id, source, sha256('row:7:' || CAST(id AS VARCHAR)) AS h FROM manifest) m
        JOIN (SELECT source, row_number() OVER (ORDER BY source) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM manifest)) s ON s.source = m.source))
    WHERE rn <= quota OR spare <= 2000 - taken"""))
def _(t):
    return cu.source_balanced_sample(t.manifest.select("id", "source"), 2000, 7)


@query("document_balanced_sample", with_bindings(
    """SELECT m.doc_id, id, document_rank, line_rank FROM (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('line:7:' || CAST(id AS VARCHAR)), id) AS line_rank FROM manifest) m
    JOIN (SELECT doc_id, row_number() OVER (ORDER BY sha256('document:7:' || CAST(doc_id AS VARCHAR)), doc_id) AS document_rank FROM (SELECT DISTINCT doc_id FROM manifest)) d ON d.doc_id = m.doc_id
    WHERE document_rank BETWEEN 6 AND 45 AND line_rank <= 3"""))
def _(t):
    return cu.document_balanced_sample(t.manifest.select("id", "doc_id"), 40, 3, 7, offset=5)


@query("ratio_split", with_bindings(
    """SELECT id, lang, CASE WHEN n <= 2 THEN 'test' WHEN (rn - 1) / n < 0.7 THEN 'train' WHEN (rn - 1) / n < 0.85 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)"""))
def _(t):
    return cu.ratio_split(t.documents.select(F.col("doc_id").alias("id"), "lang"), ["lang"])


@query("fifth_document_split", with_bindings(
    """SELECT source, doc_id, CASE WHEN n > 1 AND (rn - 1) % 5 = 4 THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)"""))
def _(t):
    return cu.fifth_document_split(t.documents.select("source", "doc_id"))


@query("numeric_tokens", with_bindings(
    r"""SELECT id, CAST(pos AS INTEGER) AS word_no, token FROM (SELECT id, pos, trim(regexp_replace(regexp_replace(regexp_replace(w, '^[()\[\]{}:;]+|[()\[\]{}:;]+$', '', 'g'), '^₺?\$?', ''),
      'TL(TRY)?$|TRY$', '')) AS token FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS ws FROM manifest)))
    WHERE regexp_matches(token, '^(?:[0-9]+(?:[,.][0-9]+)+|[0-9]{2,})$')"""))
def _(t):
    return cu.numeric_tokens(t.manifest)


BOX = """box AS (SELECT * FROM (SELECT doc_id, kind, ord, a AS x1, b AS y1, CASE WHEN format = 'xywh' THEN a + c ELSE c END AS x2, CASE WHEN format = 'xywh' THEN b + d ELSE d END AS y2 FROM raw_box)
    WHERE x2 > x1 AND y2 > y1)"""


@query("normalise_boxes", with_bindings("SELECT * FROM box", BOX))
def _(t):
    return cu.normalise_boxes(t.raw_box)


@query("reading_order", with_bindings(
    "SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY y1 + (y2 - y1) // 2, x1, ord, x2, y2) AS reading_position FROM box", BOX))
def _(t):
    return cu.reading_order(cu.normalise_boxes(t.raw_box))


PAIRS = """pair AS (SELECT doc_id, truth, pred, o / (a + b - o) AS iou, o / a AS truth_covered, o / b AS pred_covered FROM (
    SELECT t.doc_id, t.ord AS truth, p.ord AS pred, (least(t.x2, p.x2) - greatest(t.x1, p.x1)) * (least(t.y2, p.y2) - greatest(t.y1, p.y1)) AS o, (t.x2 - t.x1) * (t.y2 - t.y1) AS a, (p.x2 - p.x1) * (p.y2 - p.y1) AS b
    FROM (SELECT * FROM box WHERE kind = 'truth') t JOIN (SELECT * FROM box WHERE kind = 'pred') p USING (doc_id)
    WHERE least(t.x2, p.x2) > greatest(t.x1, p.x1) AND least(t.y2, p.y2) > greatest(t.y1, p.y1)))"""
JUDGED = """SELECT *, bool_or(hit) OVER (PARTITION BY doc_id, truth) OR bool_or(hit) OVER (PARTITION BY doc_id, pred) AS gone FROM (SELECT doc_id, truth, pred, iou,
    row_number() OVER (PARTITION BY doc_id, truth ORDER BY iou DESC, pred) = 1 AND row_number() OVER (PARTITION BY doc_id, pred ORDER BY iou DESC, truth) = 1 AS hit FROM {0})"""
DETECTION = (
    BOX, PAIRS, "close AS (SELECT * FROM pair WHERE iou >= 0.5)",
    f"rounds AS ( {JUDGED.format('close')} UNION ALL {JUDGED.format('(SELECT * FROM rounds WHERE NOT gone)')})",
    "matched AS (SELECT * FROM rounds WHERE hit)",
    """detection AS (SELECT doc_id, truths, preds, m AS matched, truths - m AS missed, preds - m AS duplicates, coalesce(g.merged, 0) AS merged, coalesce(s.split, 0) AS split,
      round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(coalesce(mean_iou, 0), 6) AS mean_iou, round(coalesce(median_iou, 0), 6) AS median_iou,
      round(coalesce(kept / pairs, 1), 6) AS order_accuracy
    FROM (SELECT *, coalesce(n, 0) AS m, CASE WHEN preds = 0 THEN CASE WHEN truths = 0 THEN 1 ELSE 0 END ELSE coalesce(n, 0) / preds END AS p, CASE WHEN truths = 0 THEN CASE WHEN preds = 0 THEN 1 ELSE 0 END ELSE coalesce(n, 0) / truths END AS r FROM (
        SELECT doc_id, count(*) FILTER (WHERE kind = 'truth') AS truths, count(*) FILTER (WHERE kind = 'pred') AS preds FROM box GROUP BY doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n, avg(iou) AS mean_iou, quantile_cont(iou, 0.5) AS median_iou FROM matched GROUP BY doc_id) USING (doc_id)) b
    LEFT JOIN (SELECT doc_id, count(*) AS merged FROM (SELECT doc_id, pred FROM pair WHERE truth_covered >= 0.5 GROUP BY doc_id, pred HAVING count(*) >= 2) GROUP BY doc_id) g USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS split FROM (SELECT doc_id, truth FROM pair WHERE pred_covered >= 0.5 GROUP BY doc_id, truth HAVING count(*) >= 2) GROUP BY doc_id) s USING (doc_id)
    LEFT JOIN (SELECT x.doc_id, count(*) AS pairs, count(*) FILTER (WHERE x.pred < y.pred) AS kept FROM matched x JOIN matched y ON x.doc_id = y.doc_id AND x.truth < y.truth GROUP BY x.doc_id) o USING (doc_id))""",
)


def recursive(body: str, *steps: str) -> str:
    return with_bindings(body, *steps).replace("WITH ", "WITH RECURSIVE ", 1)


@query("box_pairs", with_bindings("SELECT doc_id, truth, pred, round(iou, 6) AS iou FROM pair", BOX, PAIRS))
def _(t):
    return cu.box_pairs(cu.normalise_boxes(t.raw_box)).select("doc_id", "truth", "pred", F.round("iou", 6).alias("iou"))


@query("box_detection_scores", recursive("SELECT * FROM detection", *DETECTION))
def _(t):
    return cu.box_detection_scores(cu.normalise_boxes(t.raw_box))


@query("box_detection_summary", recursive(
    """SELECT *, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM (SELECT * , matched / (matched + duplicates) AS p, matched / (matched + missed) AS r FROM (
      SELECT count(*) AS documents, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(merged) AS BIGINT) AS merged,
        CAST(sum(split) AS BIGINT) AS split, round(avg(mean_iou), 6) AS mean_iou, round(quantile_cont(median_iou, 0.5), 6) AS median_iou, round(avg(order_accuracy), 6) AS order_accuracy FROM detection))""".replace("SELECT *, round(p", "SELECT * EXCLUDE (p, r), round(p"), *DETECTION))
def _(t):
    return cu.detection_summary(cu.box_detection_scores(cu.normalise_boxes(t.raw_box)))


@query("content_dedupe", with_bindings(
    """SELECT id, tenant_id, sha256(text) AS sha256, min(id) OVER w AS survivor_id, id <> min(id) OVER w AS duplicate FROM document_file
    WINDOW w AS (PARTITION BY tenant_id, sha256(text))"""))
def _(t):
    return cu.content_dedupe(t.document_file)


@query("line_dedupe", with_bindings(
    r"""SELECT id, CAST(count(*) AS INTEGER) AS lines, CAST(count(*) FILTER (WHERE first) AS INTEGER) AS kept, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first) AS text FROM (
      SELECT *, row_number() OVER (PARTITION BY id, replace(lower(line), ' ', '') ORDER BY pos) = 1 AS first FROM (
        SELECT id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS line, pos FROM (SELECT id, unnest(xs) AS x, generate_subscripts(xs, 1) AS pos FROM (SELECT id, string_split(text, chr(10)) AS xs FROM document_file)))
      WHERE line <> '') GROUP BY id"""))
def _(t):
    return cu.line_dedupe(t.document_file)


@query("corpora_union", with_bindings(
    """SELECT doc_id AS id, text, lang, NULL AS role, TRUE AS usable_for_training, FALSE AS usable_for_benchmark FROM documents
    UNION ALL SELECT item_id, text, NULL, NULL, FALSE, TRUE FROM benchmark UNION ALL SELECT conv_id, text, NULL, role, TRUE, FALSE FROM conversations"""))
def _(t):
    flags = lambda a, b: {"usable_for_training": F.lit(a), "usable_for_benchmark": F.lit(b)}
    return cu.corpora_union(
        t.documents.select(F.col("doc_id").alias("id"), "text", "lang").withColumns(flags(True, False)),
        t.benchmark.select(F.col("item_id").alias("id"), "text").withColumns(flags(False, True)),
        t.conversations.select(F.col("conv_id").alias("id"), "text", "role").withColumns(flags(True, False)))


MASK = "regexp_replace(regexp_replace({0}, '\\p{{Nd}}', '0', 'g'), '\\p{{L}}', 'X', 'g')"
CORRECTED = """correction AS (SELECT o_orderkey % 200 AS document_id, CASE o_orderkey % 6 WHEN 0 THEN 'full_text' WHEN 1 THEN 'ocr_text' WHEN 2 THEN NULL WHEN 3 THEN 'merchant' WHEN 4 THEN 'total' ELSE 'date' END AS field,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Old ' || o_custkey END AS before_value, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus || o_custkey || ' Ünal' END AS after_value, o_orderkey AS ord FROM orders)"""


def corrections(t):
    key = F.col("o_orderkey")
    field = F.element_at(F.array(F.lit("full_text"), F.lit("ocr_text"), F.lit(None).cast("string"), F.lit("merchant"), F.lit("total"), F.lit("date")), (key % 6 + 1).cast("int"))
    return t.orders.select(
        (key % 200).alias("document_id"), field.alias("field"), F.when(key % 7 != 0, F.concat(F.lit("Old "), F.col("o_custkey").cast("string"))).alias("before_value"),
        F.when(key % 11 != 0, F.concat("o_orderstatus", F.col("o_custkey").cast("string"), F.lit(" Ünal"))).alias("after_value"), key.alias("ord"))


def listed(fields: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?")))), ",")


@query("correction_dataset", with_bindings(
    f"""SELECT d.id, d.kind AS document_type, {MASK.format('d.safe_name')} AS safe_name, {MASK.format('max(CASE WHEN slot = ' + "'full_text'" + ' THEN after_value END)')} AS corrected_text,
      coalesce(string_agg(slot || '=' || {MASK.format('after_value')}, ',' ORDER BY slot) FILTER (WHERE slot <> 'full_text'), '') AS corrected_fields,
      coalesce(string_agg(slot || '=' || coalesce({MASK.format('before_value')}, '?'), ',' ORDER BY slot) FILTER (WHERE slot <> 'full_text'), '') AS previous_fields, 'train' AS split, TRUE AS anonymised
    FROM document_file d LEFT JOIN (SELECT document_id, slot, coalesce(after_value, '') AS after_value, before_value FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id, slot ORDER BY ord DESC) AS r FROM (SELECT *, CASE WHEN field IS NULL OR field = 'ocr_text' THEN 'full_text' ELSE field END AS slot FROM correction)) WHERE r = 1) l ON l.document_id = d.id
    GROUP BY d.id, d.kind, d.safe_name""", CORRECTED))
def _(t):
    rows = cu.correction_dataset(t.document_file.select("id", "kind", "safe_name"), corrections(t), True)
    return rows.withColumns({"corrected_fields": listed("corrected_fields"), "previous_fields": listed("previous_fields")})


@query("masked_labels", with_bindings(
    f"""SELECT id, '{{"role": "' || {MASK.format('role')} || '", "turn": ' || turn || ', "words": ["' || {MASK.format('substr(translate(text, chr(10) || chr(34) || chr(92), ' + "'  '" + '), 1, 40)')} || '", {{"k1": "X0 \\"X\\"", "n": null}}]}}' AS payload FROM annotation"""))
def _(t):
    words = F.substring(F.translate("text", '\n"\\', "  "), 1, 40)
    payload = F.concat(F.lit('{"role": "'), "role", F.lit('", "turn": '), F.col("turn").cast("string"), F.lit(', "words": ["'), words, F.lit('", {"k1": "a1 \\"b\\"", "n": null}]}'))
    return cu.masked_labels(t.annotation.select("id", payload.alias("payload")))
