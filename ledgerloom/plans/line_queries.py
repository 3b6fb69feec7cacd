"""Line rules, column expressions and payloads: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..operators import lines
from .bindings import with_bindings
from .category_queries import routed
from .registry import query

FOLD = "translate(replace(lower({0}), 'ß', 'ss'), 'çğıöşü', 'cgiosu')"
AMOUNT = r"(^|[^0-9])([0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2})($|[^0-9])"
DATE = r"(^|[^0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})($|[^0-9])"


@query("line_role", with_bindings(
    f"""SELECT sample_id, CASE WHEN regexp_matches(text, '{DATE}') THEN 'date' WHEN regexp_matches(text, '(^|[^0-9])[0-9]{{1,2}}:[0-9]{{2}}($|[^0-9])') THEN 'time'
      WHEN regexp_matches(f, '{lines.IDENTIFIER}') THEN 'identifier' WHEN regexp_matches(text, '{AMOUNT}') AND regexp_matches(f, '{lines.AMOUNT_WORDS}') THEN 'amount_with_label'
      WHEN regexp_matches(text, '{AMOUNT}') THEN 'amount' WHEN regexp_matches(f, '{lines.ITEM_WORDS}') THEN 'line_item' ELSE 'general_text' END AS role
    FROM (SELECT *, {FOLD.format('text')} AS f FROM doc_line)"""))
def _(t):
    return t.doc_line.select("sample_id", lines.line_role(F.col("text")).alias("role"))


STRUCTURE = f"""structured AS (SELECT doc_id, text, confidence, CASE WHEN len(w) = 0 THEN 0.25 ELSE round(greatest(0.25, least(0.25::DOUBLE + CASE WHEN am THEN 0.15 ELSE 0 END + CASE WHEN dt THEN 0.25 ELSE 0 END
      + CASE WHEN contains(f, 'toplam') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(f, '{lines.DOCUMENT_WORDS}') THEN 0.10 ELSE 0 END + CASE WHEN regexp_matches(f, '{lines.PAYMENT_WORDS}') THEN 0.05 ELSE 0 END
      + CASE WHEN regexp_matches(f, '{lines.MERCHANT_WORDS}') THEN 0.05 ELSE 0 END + CASE WHEN len(w) >= 4 AND len(list_distinct(w)) / len(w) >= 0.35 THEN 0.05 ELSE 0 END,
      CASE WHEN dt THEN 1 ELSE 0.7 END, CASE WHEN am THEN 1 ELSE 0.65 END)), 4) END AS structure
    FROM (SELECT *, regexp_extract_all(f, '[a-z0-9]+') AS w, regexp_matches(f, '{AMOUNT}') AS am, regexp_matches(f, '{DATE}') AS dt FROM (SELECT *, {FOLD.format('text')} AS f FROM ocr_text)))"""


@query("structure_score", with_bindings("SELECT doc_id, CAST(structure AS DOUBLE) AS structure FROM structured", STRUCTURE))
def _(t):
    return lines.structure_score(t.ocr_text).select("doc_id", "structure")


@query("fragmentation_flag", with_bindings(
    r"""SELECT doc_id, coalesce(n >= 12 AND (short / n >= 0.12 OR mean < 5), FALSE) AS fragmented FROM ocr_text LEFT JOIN (SELECT doc_id AS d, count(*) AS n, count(*) FILTER (WHERE c <= 2) AS short, avg(c) AS mean
      FROM (SELECT doc_id, length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM ocr_text) WHERE trim(x) <> '') GROUP BY doc_id) ON d = doc_id"""))
def _(t):
    return lines.fragmentation_flag(t.ocr_text.withColumn("segmentation", F.lit(0.5))).select("doc_id", "fragmented")


def tokens(t):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), (i * 10).alias("x0"), (i * 10 + 8).alias("x1")))


@query("line_chunks")
def _(t):
    return lines.line_chunks(t.doc_line.select(F.col("sample_id").alias("line_id"), "text", tokens(t).alias("tokens")))


@query("clean_tokens", with_bindings(
    """SELECT sample_id, CAST(len(k) AS INTEGER) AS tokens, round(coalesce(list_avg(list_transform(k, lambda i: least(1.0, i / 10.0))), 0), 6) AS mean_confidence FROM (
      SELECT sample_id, list_filter(range(len(list_filter(string_split(text, ' '), lambda w: w <> ''))), lambda i: i % 4 <> 3 AND i % 7 <> 6) AS k FROM doc_line)"""))
def _(t):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    token = F.transform(words, lambda w, i: F.struct(
        w.alias("text"), F.when(i % 7 != 6, i / 10.0).alias("confidence"),
        F.array(F.lit(1.0), F.when(i % 4 == 3, -1.0).otherwise(2.0), F.lit(3.0), F.lit(4.0)).alias("bbox")))
    rows = lines.clean_tokens(t.doc_line.select("sample_id", token.alias("tokens")))
    return rows.select("sample_id", F.size("tokens").alias("tokens"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query("candidate_quality")
def _(t):
    return lines.candidate_quality(routed(t)).select("sample_id", "champion_score", "challenger_score", "reason", "accepted")


@query("semantic_guard")
def _(t):
    return routed(t).select("sample_id", lines.semantic_guard(F.col("champion_text"), F.col("challenger_text")).alias("reason"))


@query("confidence_rollup", with_bindings(
    """SELECT s.doc_id, CAST(structure AS DOUBLE) AS structure, round(coalesce(m, 0) * 0.9::DOUBLE * 0.8::DOUBLE * structure * 0.95::DOUBLE, 4) AS calibrated,
      concat_ws(',', CASE WHEN round(coalesce(m, 0) * 0.9::DOUBLE * 0.8::DOUBLE * structure * 0.95::DOUBLE, 4) < 0.75 THEN 'CUSTOM_OCR_LOW_CONFIDENCE' END,
      CASE WHEN structure <= 0.75 THEN 'CUSTOM_OCR_LOW_REAL_DOCUMENT_CONFIDENCE' END) AS warnings
    FROM structured s LEFT JOIN (SELECT doc_id, round_even(avg((length(text) % 50) / 50.0), 4) AS m FROM doc_line GROUP BY doc_id) l ON l.doc_id = s.doc_id WHERE s.doc_id IN (SELECT doc_id FROM documents)""",
    STRUCTURE.replace("FROM ocr_text)", "FROM (SELECT doc_id, text, 0 AS confidence FROM documents))")))
def _(t):
    line = t.doc_line.select("doc_id", ((F.length("text") % 50) / 50.0).alias("confidence"))
    pages = F.explode(F.array(F.struct(F.lit(1.0).alias("quality"), F.lit(0.95).alias("segmentation")),
                              F.struct(F.lit(0.8).alias("quality"), F.lit(1.0).alias("segmentation"))))
    page = t.documents.select("doc_id", pages.alias("p")).select("doc_id", "p.*")
    return lines.confidence_rollup(line, page, t.documents.select("doc_id", "text", F.lit(0.9).alias("reliability")))


@query("line_item_scores", with_bindings(
    """SELECT CAST(tp AS BIGINT) AS tp, CAST(p - tp AS BIGINT) AS fp, CAST(e - tp AS BIGINT) AS fn, round(tp / p, 6) AS precision, round(tp / e, 6) AS recall, round(2 * tp / (p + e), 6) AS f1 FROM (
      SELECT sum(least(e, p)) AS tp, sum(e) AS e, sum(p) AS p FROM (SELECT k, d, a, sum(e) AS e, sum(p) AS p FROM (
        SELECT l_orderkey AS k, l_partkey % 50 AS d, CAST(l_quantity AS INTEGER) AS a, 1 AS e, 0 AS p FROM lineitem WHERE l_linenumber < 5
        UNION ALL SELECT l_orderkey, l_partkey % 50, CAST(l_quantity AS INTEGER) + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END, 0, 1 FROM lineitem
          WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 5)) GROUP BY 1, 2, 3))"""))
def _(t):
    amount = F.col("l_quantity").cast("int")
    base = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), (F.col("l_partkey") % 50).cast("string").alias("description"), "l_linenumber", amount.alias("q"))
    expected = base.where("l_linenumber < 5").withColumn("amount", F.col("q").cast("string"))
    predicted = base.withColumn("amount", (F.col("q") + F.when(F.col("l_linenumber") == 2, 1).otherwise(0)).cast("string"))
    return lines.line_item_scores(expected, predicted)


@query("truth_to_reference", with_bindings(
    """SELECT doc_id, string_agg(l, chr(10) ORDER BY k) AS reference FROM (SELECT doc_id, l, k, row_number() OVER (PARTITION BY doc_id, replace(lower(l), ' ', '') ORDER BY k) AS r FROM (
      SELECT doc_id, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS l, k FROM (SELECT doc_id, unnest([t_merchant, 'Toplam  ' || amount1, t_merchant, 'TARIH ' || strftime(TRY_CAST(t_date AS DATE), '%d.%m.%Y'),
        item1 || ' ' || regexp_replace(amount1, '^([^,]*)\\.([0-9]{2})$', '\\1,\\2') || ' TL', item2 || ' ' || regexp_replace(amount2, '^([^,]*)\\.([0-9]{2})$', '\\1,\\2') || ' TL',
        'ARA TOPLAM ' || t_subtotal || ' TL', 'KDV ' || nullif(t_tax, ' ') || ' TL', 'GENEL TOPLAM ' || t_total || ' TL', 'ODEME ' || t_payment]) AS l, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 1) AS k FROM scan))
      WHERE coalesce(l, '') <> '') WHERE r = 1 GROUP BY doc_id"""))
def _(t):
    item = lambda k: F.when(F.col(f"item{k}").isNotNull(), F.struct(F.col(f"item{k}").alias("description"), F.col(f"amount{k}").alias("amount")))
    truth = t.scan.select(
        "doc_id", F.array("t_merchant", F.concat(F.lit("Toplam  "), "amount1")).alias("snippets"), F.col("t_merchant").alias("merchant"), F.col("t_date").try_cast("date").alias("date"),
        F.filter(F.array(item(1), item(2)), lambda i: i.isNotNull()).alias("line_items"), F.col("t_subtotal").alias("subtotal"), F.nullif("t_tax", F.lit(" ")).alias("tax"),
        F.col("t_total").alias("total"), F.col("t_payment").alias("payment_method"))
    return lines.truth_to_reference(truth).where("reference <> ''").select("doc_id", "reference")


@query("annotation_summary", with_bindings(
    """SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN 'BOX_LABEL' END AS payload_kind, 'CUSTOM_CRNN' AS engine, CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 1 END AS page_count,
    CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS token_count, k % 5 <> 0 OR k % 7 = 0 AS has_box FROM keyed_event"""))
def _(t):
    k = F.col("k")
    parts = F.concat_ws(",", F.when(k % 2 == 0, '"type":" box-label"'), F.lit('"engine":"custom crnn"'),
                        F.when(k % 3 == 0, '"pageNumbers":[1,2,2]').when(k % 3 == 1, '"pageNumber":4'),
                        F.when(k % 5 != 0, '"tokens":[{"bbox":[1,2]},{"text":"x"}]'), F.when(k % 7 == 0, '"bbox":[1,2,3,4]'))
    return lines.annotation_summary(t.keyed_event.select(F.col("event_id").alias("id"), F.concat(F.lit("{"), parts, F.lit("}")).alias("payload")))


@query("payload_ingest")
def _(t):
    return lines.qr_payloads(t.payload)


@query("payload_ingest_xml", with_bindings(
    """SELECT payload_id, 'UBL_TR_XML' AS kind, CASE WHEN g THEN 'INV' || payload_id END AS document_number, CASE WHEN g THEN 'Seller ' || regexp_extract(payload, 'Seller ([0-9]+)', 1) END AS merchant,
      CASE WHEN g THEN '1234567890' END AS tax_id, CASE WHEN g THEN DATE '2024-03-04' END AS date, CASE WHEN g THEN '10:11' END AS time, CASE WHEN g THEN 'EUR' ELSE 'TRY' END AS currency,
      CASE WHEN g THEN 10000::BIGINT END AS subtotal_minor, CASE WHEN g THEN 1800::BIGINT END AS tax_minor, CASE WHEN g THEN 11800::BIGINT END AS total_minor,
      CASE WHEN g THEN CASE WHEN payload_id % 3 = 0 THEN 12000::BIGINT ELSE 11800 END END AS payable_minor, CAST(NULL AS VARCHAR) AS payment_method, CAST(NULL AS VARCHAR) AS card_last4,
      CASE WHEN NOT g THEN 'MALFORMED_DOCUMENT,MISSING_DOCUMENT_NUMBER,MISSING_DATE,MISSING_TOTAL,MISSING_MERCHANT' WHEN payload_id % 3 = 0 THEN 'TOTAL_TAX_MISMATCH' ELSE '' END AS issues
    FROM (SELECT *, payload_id % 7 <> 0 AS g FROM xml_payload)"""))
def _(t):
    return lines.xml_invoices(t.xml_payload)


@query("column_expressions", with_bindings(
    r"""SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS locale_minor, 'order-' || o_orderkey || '.csv' AS safe_name, sha256(CAST(o_orderkey AS VARCHAR)) AS digest, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(crc_table[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8))) AS crc,
      'X00 ' || regexp_replace(o_orderpriority, '[A-Z]', 'X', 'g').replace('1', '0').replace('2', '0').replace('3', '0').replace('4', '0').replace('5', '0') AS masked,
      CAST(o_orderdate AS DATE) AS mixed_date, 'Tür' AS repaired, 'Gül' AS scored, 'Ärger' AS kept FROM orders, (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_table)"""))
def _(t):
    euro = F.format_number(F.col("o_totalprice"), 2)
    turkish = F.concat(F.translate(euro, ",.", ".,"), F.lit(" TL"))
    day = F.date_format("o_orderdate", "d.M.yyyy")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), money.parse_locale_amount(turkish).alias("locale_minor"),
        text.safe_name(F.concat(F.lit("..Order "), F.col("o_orderkey").cast("string"), F.lit("!..csv"))).alias("safe_name"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"), F.crc32(F.col("o_orderkey").cast("string").cast("binary")).alias("crc"), text.mask(F.concat(F.lit("a12 "), F.col("o_orderpriority"))).alias("masked"),
        dates.parse_mixed_date(day).alias("mixed_date"), text.repair_mojibake(F.lit("TÃ¼r")).alias("repaired"),
        text.repair_mojibake_scored(F.lit("GÃ¼l")).alias("scored"), text.repair_mojibake_scored(F.lit("Ärger")).alias("kept"))
