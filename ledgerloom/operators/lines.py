"""Rules on single recognised lines and their roll-up; payloads and field scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from ..functions.dates import normalise_time, parse_mixed_date
from ..functions.money import CURRENCIES, parse_locale_amount
from ..functions.text import strip_accents
from .quality import f1, ratio

# Patterns and words of the line rules.
AMOUNT = r"(?<![0-9])[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2}(?![0-9])"
DATE = r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})(?![0-9])"
TIME = r"(?<![0-9])[0-9]{1,2}:[0-9]{2}(?![0-9])"
IDENTIFIER = r"\b(?:iban|vkn|tckn|fis no|fatura no|receipt|invoice)\b"
CURRENCY = r"(?i)(?:₺|\$|€|£|\b(?:TL|TRY|USD|EUR|GBP)\b)"
AMOUNT_WORDS = "toplam|total|tutar|amount|kdv|vat"
ITEM_WORDS = "urun|adet|miktar|birim|aciklama"
DOCUMENT_WORDS = "fis|fatura|kdv|vkn|tckn|iban"
PAYMENT_WORDS = "tl|try|kart|nakit|odeme"
MERCHANT_WORDS = "market|ltd|limited|anonim|sanayi|ticaret"
PROTECTED = ("general_text", "merchant_header")


def ascii_fold(text: Column) -> Column:
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "çğıöşü", "cgiosu")


def amount_tokens(text: Column) -> Column:
    found = F.transform(
        F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), lambda a: F.translate(F.translate(a, ".", ""), ",", ".")
    )
    return F.array_sort(F.array_distinct(found))


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def alnum(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def repeated_ratio(text: Column) -> Column:
    tokens = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")
    return let(tokens, lambda w: F.when(F.size(w) < 2, 0.0).otherwise(
        F.lit(1.0) - F.size(F.array_distinct(w)) / F.size(w)))


def line_role(text: Column, header: Column | None = None) -> Column:
    """Role of a line; ``header`` says whether its place suits a merchant header."""
    folded = ascii_fold(text)
    has_amount = text.rlike(AMOUNT)
    return (
        F.when(text.rlike(DATE), "date").when(text.rlike(TIME), "time").when(folded.rlike(IDENTIFIER), "identifier")
        .when(has_amount & folded.rlike(AMOUNT_WORDS), "amount_with_label").when(has_amount, "amount")
        .when(folded.rlike(ITEM_WORDS), "line_item")
        .when(F.lit(False) if header is None else header, "merchant_header").otherwise("general_text")
    )


def structure_score(docs: DataFrame) -> DataFrame:
    """Adds ``structure`` 0.25..1: how much a text looks like an expense document."""
    df = docs.withColumn("__f", ascii_fold(F.col("text"))).withColumn("__w", all_of(F.col("__f"), "[a-z0-9]+"))
    add = lambda cond, value: F.when(cond, value).otherwise(0.0)
    folded, size = F.col("__f"), F.size("__w")
    has_amount, has_date = folded.rlike(AMOUNT), folded.rlike(DATE)
    varied = (size >= 4) & (F.size(F.array_distinct("__w")) / F.greatest(size, F.lit(1)) >= 0.35)
    # Weights and caps.
    score = (
        F.lit(0.25) + add(has_amount, 0.15) + add(has_date, 0.25) + add(folded.rlike("toplam"), 0.15)
        + add(folded.rlike(DOCUMENT_WORDS), 0.10) + add(folded.rlike(PAYMENT_WORDS), 0.05)
        + add(folded.rlike(MERCHANT_WORDS), 0.05) + add(varied, 0.05)
    )
    capped = F.least(score, F.when(has_date, 1.0).otherwise(0.70), F.when(has_amount, 1.0).otherwise(0.65))
    value = F.when(size == 0, 0.25).otherwise(F.round(F.greatest(F.lit(0.25), capped), 4))
    return df.withColumn("structure", value).drop("__f", "__w")


def fragmentation_flag(docs: DataFrame) -> DataFrame:
    """Adds ``fragmented``: many lines, mostly stubs, on a badly cut page."""
    counts = F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: alnum(F.trim(x)))
    df = docs.withColumn("__c", counts)
    n = F.greatest(F.size("__c"), F.lit(1))
    short = F.size(F.filter("__c", lambda c: c <= 2)) / n
    mean = F.aggregate("__c", F.lit(0), lambda a, c: a + c) / n
    flag = (F.size("__c") >= 12) & ((short >= 0.12) | (mean < 5.0)) & (F.col("segmentation") < 0.8)
    return df.withColumn("fragmented", flag).drop("__c")


def line_chunks(line: DataFrame, maximum: int = 48, minimum: int = 56) -> DataFrame:
    """Long lines packed greedily into chunks of at most ``maximum`` characters.

    ``tokens`` holds (text, x0, x1) in order; the fold keeps finished chunks and
    the open one, so a line stays inside its row."""
    chunk = "struct<text:string,x0:double,x1:double>"
    tokens = F.transform("tokens", lambda t: F.struct(
        t["text"].alias("text"), t["x0"].cast("double").alias("x0"), t["x1"].cast("double").alias("x1")))
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast(chunk).alias("open"))

    def add(acc: Column, t: Column) -> Column:
        fits = acc["open"].isNull() | (F.length(acc["open"]["text"]) + 1 + F.length(t["text"]) <= maximum)
        joined = F.struct(
            F.concat(acc["open"]["text"], F.lit(" "), t["text"]).alias("text"),
            F.least(acc["open"]["x0"], t["x0"]).alias("x0"), F.greatest(acc["open"]["x1"], t["x1"]).alias("x1"))
        grown = F.when(acc["open"].isNull(), t).otherwise(joined)
        closed = F.concat(acc["done"], F.array(acc["open"]))
        return F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, grown).otherwise(t).alias("open"))

    packed = F.aggregate(tokens, start, add, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    long_line = (F.length("text") >= minimum) & (F.size("tokens") >= 2)
    df = line.withColumn("__chunks", F.when(long_line, packed))
    rows = df.select("line_id", F.posexplode_outer("__chunks").alias("chunk_no", "c"), F.size("__chunks").alias("n"))
    return rows.where(F.col("n") > 1).select("line_id", "chunk_no", "c.*")


def clean_tokens(docs: DataFrame) -> DataFrame:
    """Usable tokens only, with clamped confidence, and their mean confidence."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    good = lambda t: (
        t["text"].isNotNull() & t["confidence"].isNotNull() & (F.size(t["bbox"]) == 4) & F.forall(t["bbox"], finite))
    clamped = lambda t: F.struct(
        t["text"].alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t["confidence"])).alias("confidence"),
        t["bbox"].alias("bbox"))
    df = docs.withColumn("tokens", F.transform(F.filter("tokens", good), clamped))
    mean = F.try_divide(F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["confidence"]), F.size("tokens"))
    return df.withColumn("mean_confidence", F.coalesce(mean, F.lit(0.0)))


def candidate_quality(pair: DataFrame) -> DataFrame:
    """Scores of both readings of a line and whether the challenger may replace the champion."""

    def score(c: str) -> Column:
        text = F.trim(F.col(f"{c}_text"))
        fits = (
            F.when(F.col("line_role").isin("amount", "amount_with_label"), text.rlike(AMOUNT))
            .when(F.col("line_role") == "date", text.rlike(DATE)).otherwise(F.lit(True))
        )
        # Weights.
        raw = (
            F.col(f"{c}_confidence") * 0.55 + F.least(alnum(text) / 24.0, F.lit(1.0)) * 0.25
            + F.when(fits, 0.15).otherwise(0.0) + F.greatest(F.lit(0.0), F.lit(0.05) - repeated_ratio(text) * 0.05)
        )
        return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)

    a, b = F.col("champion_text"), F.col("challenger_text")
    df = pair.withColumns({"champion_score": score("champion"), "challenger_score": score("challenger")})
    a_amounts, b_amounts = amount_tokens(a), amount_tokens(b)
    numeric = (F.size(a_amounts) > 0) | (F.size(b_amounts) > 0) | a.rlike(CURRENCY) | b.rlike(CURRENCY)
    reason = (
        F.when(~F.col("line_role").isin(*PROTECTED), "champion_fallback_protected_role")
        .when(F.col("aspect_ratio") < 6.0, "champion_fallback_not_long_line")
        .when(a_amounts != b_amounts, "champion_fallback_amount_disagreement")
        .when(numeric, "champion_fallback_numeric_evidence")
        .when(all_of(a, DATE) != all_of(b, DATE), "champion_fallback_date_disagreement")
        .when((F.col("challenger_confidence") < 0.02)
              | (F.col("challenger_confidence") + 0.02 < F.col("champion_confidence")), "champion_fallback_confidence_floor")
        .when(F.col("challenger_score") < F.col("champion_score") + 0.04, "champion_fallback_insufficient_margin")
        .when(repeated_ratio(b) > 0.35, "champion_fallback_repetition_risk")
        .otherwise("validated_long_line_challenger_margin")
    )
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "validated_long_line_challenger_margin")


def semantic_guard(a: Column, b: Column) -> Column:
    """Why two readings must not be exchanged; null when nothing speaks against it."""
    as_set = lambda x: F.array_sort(F.array_distinct(x))
    return (
        F.when(amount_tokens(a) != amount_tokens(b), "champion_fallback_pairwise_amount_disagreement")
        .when(as_set(all_of(a, DATE)) != as_set(all_of(b, DATE)), "champion_fallback_pairwise_date_disagreement")
        .when(as_set(all_of(F.upper(a), CURRENCY)) != as_set(all_of(F.upper(b), CURRENCY)),
              "champion_fallback_pairwise_currency_disagreement")
        .when(alnum(b) < 3, "champion_fallback_pairwise_empty_challenger")
        .when(repeated_ratio(b) > 0.35, "champion_fallback_pairwise_repetition_risk")
    )


def confidence_rollup(line: DataFrame, page: DataFrame, document: DataFrame) -> DataFrame:
    """Document confidence: mean line confidence times reliability, structure and
    the worst page's quality and segmentation, with warning codes."""
    lines = line.groupBy("doc_id").agg(F.avg("confidence").alias("mean"))
    pages = page.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("segmentation").alias("segmentation"))
    joined = structure_score(document).join(lines, "doc_id", "left").join(pages, "doc_id", "left")
    value = F.coalesce(F.bround("mean", 4), F.lit(0.0)) * F.col("reliability") * F.coalesce("quality", F.lit(1.0)) * F.col(
        "structure") * F.coalesce("segmentation", F.lit(0.0))
    warn = F.array(
        F.when(F.col("calibrated") < 0.75, "CUSTOM_OCR_LOW_CONFIDENCE"),
        F.when(F.col("structure") <= 0.75, "CUSTOM_OCR_LOW_REAL_DOCUMENT_CONFIDENCE"))
    return joined.withColumn("calibrated", F.round(value, 4)).select(
        "doc_id", "structure", "calibrated", F.array_join(F.filter(warn, lambda w: w.isNotNull()), ",").alias("warnings"))


# --- scores of extracted items ----------------------------------------------------------


def match_text(value: Column) -> Column:
    marked = F.replace(F.replace(F.upper(value), F.lit("₺"), F.lit(" TL ")), F.lit("TRY"), F.lit(" TL "))
    return F.trim(F.regexp_replace(marked, r"\s+", " "))


def line_item_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """One-to-one matches on (description, amount): a bag intersection, then P/R/F1."""
    keys = ["sample_id", match_text(F.col("description")).alias("d"), F.regexp_replace("amount", "[^0-9]", "").alias("a")]
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("e"))
    p = predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"))
    zero = F.lit(0)
    both = e.join(p, ["sample_id", "d", "a"], "full_outer").select(
        "sample_id", F.coalesce("e", zero).alias("e"), F.coalesce("p", zero).alias("p"))
    # Samples without any expected item are not judged.
    judged = both.join(expected.select("sample_id").distinct(), "sample_id", "left_semi")
    sums = judged.agg(F.sum(F.least("e", "p")).alias("tp"), F.sum("p").alias("p"), F.sum("e").alias("e")).select(
        "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("e") - F.col("tp")).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(f1(precision, recall), 6)})


def truth_to_reference(truth: DataFrame) -> DataFrame:
    """Reference text from structured truth, distinct lines in order.

    ``line_items`` (array of description and amount), where there, stand between date and totals. A point before
    two decimals becomes a comma."""
    comma = lambda c: F.regexp_replace(c, r"^([^,]*)\.([0-9]{2})$", "$1,$2")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    item = lambda i: F.nullif(F.concat_ws(" ", filled(i["description"]), F.concat(comma(filled(i["amount"])), F.lit(" TL"))), F.lit(""))
    items = F.transform("line_items", item) if "line_items" in truth.columns else F.array().cast("array<string>")
    money = lambda c, label: F.when(F.col(c).isNotNull(), F.concat(F.lit(label), comma(F.col(c)), F.lit(" TL")))
    head = F.array(F.col("merchant"), F.when(F.col("date").isNotNull(), F.concat(F.lit("TARIH "), F.date_format("date", "dd.MM.yyyy"))))
    extra = F.array(
        money("subtotal", "ARA TOPLAM "), money("tax", "KDV "), money("total", "GENEL TOPLAM "),
        F.when(F.col("payment_method").isNotNull(), F.concat(F.lit("ODEME "), F.col("payment_method"))))
    lines = F.filter(F.transform(F.concat("snippets", head, items, extra), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))),
                     lambda x: F.coalesce(x, F.lit("")) != "")
    df = truth.withColumn("__l", lines).withColumn(
        "__k", F.transform("__l", lambda x: F.replace(F.lower(x), F.lit(" "), F.lit(""))))
    kept = F.transform(F.array_distinct("__k"), lambda k: F.get("__l", (F.array_position("__k", k) - 1).cast("int")))
    return df.withColumn("reference", F.array_join(kept, "\n")).drop("__l", "__k")


def annotation_summary(rows: DataFrame) -> DataFrame:
    """Audit facts of an annotation payload: kind, engine, pages, tokens, boxes."""
    schema = "type string, engine string, pageNumbers array<int>, pageNumber int, bbox array<double>, tokens array<struct<bbox:array<double>>>"
    code = lambda c: F.nullif(F.substring(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9_]", "_"), 1, 80), F.lit(""))
    df = rows.withColumn("p", F.from_json("payload", schema))
    boxed = F.exists("p.tokens", lambda t: t["bbox"].isNotNull())
    return df.select(
        "id", code("p.type").alias("payload_kind"), code("p.engine").alias("engine"),
        F.when(F.col("p.pageNumbers").isNotNull(), F.size(F.array_distinct("p.pageNumbers")))
        .when(F.col("p.pageNumber").isNotNull(), 1).alias("page_count"),
        F.coalesce(F.size("p.tokens"), F.lit(0)).alias("token_count"),
        F.coalesce(boxed, F.col("p.bbox").isNotNull()).alias("has_box"))


# --- structured payloads ------------------------------------------------------------------

# Accepted keys of each invoice field, in order.
PAYLOAD_KEYS = {
    "document_number": ("documentnumber", "receiptno", "fisno", "faturano", "invoiceno", "no"),
    "merchant": ("merchant", "merchantname", "unvan", "title", "isyeri", "firma"),
    "tax_id": ("vkn", "tckn", "taxid", "vergino"), "date": ("date", "tarih", "issuedate"),
    "time": ("time", "saat", "issuetime"), "total": ("total", "tutar", "toplam", "payableamount"),
    "tax": ("tax", "kdv", "taxtotal", "vat"), "subtotal": ("subtotal", "aratoplam", "matrah"),
    "currency": ("currency", "parabirimi", "currencycode"), "payment": ("paymentmethod", "odeme", "payment"),
    "last4": ("cardlast4", "kartson4", "last4"),
}


def _payment(value: Column) -> Column:
    return (
        F.when(value.rlike("(?i)^(?:48|49|card|kredi|kart|pos)"), "CARD").when(value.rlike("(?i)^(?:10|cash|nakit)"), "CASH")
        .when(value.rlike("(?i)^(?:42|transfer|havale|eft)"), "TRANSFER").otherwise(F.upper(F.trim(value)))
    )


def _finish(df: DataFrame) -> DataFrame:
    """Typed fields and issue codes shared by both payload kinds."""
    money = {f"{m}_minor": parse_locale_amount(F.col(m)).cast("long") for m in ("subtotal", "tax", "total", "payable")}
    df = df.withColumns(money)
    payable = F.coalesce("payable_minor", "total_minor")
    currency = F.upper(F.trim(F.coalesce("currency", F.lit("TRY"))))
    negative = F.least("subtotal_minor", "tax_minor", "total_minor", "payable_minor") < 0
    rule = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), code)
    unparsed = F.lit(False)
    for m in ("subtotal", "tax", "total", "payable"):
        unparsed = unparsed | (F.col(m).isNotNull() & F.col(f"{m}_minor").isNull())
    date = parse_mixed_date(F.col("date"), swap=False)
    issues = F.array(
        rule(F.col("malformed") | unparsed, "MALFORMED_DOCUMENT"), rule(~currency.isin(*CURRENCIES), "UNSUPPORTED_CURRENCY"),
        rule(F.col("document_number").isNull(), "MISSING_DOCUMENT_NUMBER"), rule(date.isNull(), "MISSING_DATE"),
        rule(payable.isNull(), "MISSING_TOTAL"), rule(F.col("merchant").isNull(), "MISSING_MERCHANT"),
        rule(~F.col("tax_id").rlike("^[0-9]{10,11}$"), "INVALID_TAX_ID"), rule(negative, "NEGATIVE_AMOUNT"),
        rule((F.col("total_minor") != payable)
             | (F.abs(F.col("subtotal_minor") + F.col("tax_minor") - payable) > 2), "TOTAL_TAX_MISMATCH"))
    return df.select(
        "payload_id", "kind", "document_number", "merchant", "tax_id", date.alias("date"), normalise_time(F.col("time")).alias("time"),
        F.when(currency.isin(*CURRENCIES), currency).otherwise("TRY").alias("currency"), "subtotal_minor", "tax_minor", "total_minor",
        payable.alias("payable_minor"), _payment(F.col("payment")).alias("payment_method"), "card_last4",
        F.array_join(F.filter(issues, lambda i: i.isNotNull()), ",").alias("issues"))


def qr_payloads(payload: DataFrame) -> DataFrame:
    """JSON, query-string or key:value payloads to one invoice schema with issues."""
    body = F.trim("payload")
    as_json = F.when(body.startswith("{"), F.from_json(body, "map<string,string>"))
    query = F.regexp_replace(body, r"^[^?]*\?", "")
    decode = lambda v: F.coalesce(F.try_url_decode(v), v)
    pairs = lambda text, cut, mark: F.filter(F.transform(F.split(text, cut), lambda p: F.struct(
        F.trim(F.regexp_extract(p, f"^\\s*([^{mark}]+)", 1)).alias("k"), F.trim(F.regexp_extract(p, f"[{mark}](.*)$", 1)).alias("v"))),
        lambda e: (e["k"] != "") & (e["v"] != ""))
    from_query = F.when(F.contains(body, F.lit("=")), F.transform(
        pairs(query, "&", "="), lambda e: F.struct(decode(e["k"]).alias("k"), decode(e["v"]).alias("v"))))
    from_text = pairs(body, "[;|\\n]", ":=")
    from_json = F.transform(F.map_entries(as_json), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    chosen = F.when(F.size(from_json) > 0, from_json).when(F.size(from_query) > 0, from_query).otherwise(from_text)
    key = lambda k: F.lower(F.regexp_replace(k, r"[\s_-]+", ""))
    fields = F.transform(chosen, lambda e: F.struct(key(e["k"]).alias("k"), e["v"].alias("v")))
    df = payload.withColumn("__f", fields)

    def first(keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.get(_named("__f", k), F.lit(0))["v"] for k in keys])

    values = {name: first(keys) for name, keys in PAYLOAD_KEYS.items()}
    df = df.withColumns({**values, "malformed": F.coalesce(F.size("__f"), F.lit(0)) == 0, "kind": F.lit("QR_PAYLOAD")})
    digits = lambda c: F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))
    last4 = F.right(digits("last4"), F.lit(4))
    return _finish(df.withColumns({"tax_id": digits("tax_id"), "payable": F.col("total"),
                                   "card_last4": F.when(F.length(last4) == 4, last4)}))


def _named(fields: str, key: str) -> Column:
    return F.filter(fields, lambda e: e["k"] == key)


# A character that XML forbids.
NO_XML = "\uffff"


def xml_invoices(payload: DataFrame) -> DataFrame:
    """Namespaced invoice XML to the same schema. Content that does not parse is
    told apart first, because the path functions fail on it."""
    shaped = F.from_xml("payload", "_corrupt_record string, ID string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = payload.withColumn("__x", shaped)
    good = F.col("__x").isNotNull() & F.col("__x._corrupt_record").isNull() & F.col("payload").rlike(r"(?i)<\s*(?:[\w.-]+:)?Invoice\b")
    df = df.withColumn("__xml", F.when(good, F.col("payload")))
    tag = lambda *names: "".join(f"//*[local-name()='{n}']" for n in names)
    party = "AccountingSupplierParty"
    paths = {
        "document_number": "/*/*[local-name()='ID']", "merchant": tag(party, "PartyName", "Name"), "registered": tag(party, "RegistrationName"),
        "tax_id": tag(party, "PartyTaxScheme", "CompanyID"), "date": tag("IssueDate"), "time": tag("IssueTime"), "currency": tag("DocumentCurrencyCode"),
        "subtotal": tag("LegalMonetaryTotal", "LineExtensionAmount"), "tax": tag("TaxTotal", "TaxAmount"),
        "total": tag("LegalMonetaryTotal", "TaxInclusiveAmount"), "payable": tag("LegalMonetaryTotal", "PayableAmount"), "payment": tag("PaymentMeansCode"),
    }
    # Each call parses its text, so one path reads several values, of each the first node; no XML text can hold what
    # parts them. A path may have 100 operators.
    names = list(paths)
    joined = ["concat(" + f", '{NO_XML}', ".join(paths[n] for n in names[k : k + 6]) + ")" for k in range(0, len(names), 6)]
    df = df.withColumn("__values", F.concat(*[F.split(F.xpath_string("__xml", F.lit(path)), NO_XML) for path in joined]))
    at = lambda name: F.nullif(F.trim(F.get("__values", F.lit(names.index(name)))), F.lit(""))
    read = {name: at(name) for name in names if name not in ("merchant", "registered", "tax_id")}
    return _finish(df.withColumns({
        "kind": F.lit("UBL_TR_XML"), "malformed": ~good, **read, "merchant": F.coalesce(at("merchant"), at("registered")),
        "tax_id": F.nullif(F.regexp_replace(at("tax_id"), "[^0-9]", ""), F.lit("")), "card_last4": F.lit(None).cast("string")}).drop("__values"))
