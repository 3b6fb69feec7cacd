"""Scoring of recognised documents: the plain extractor used for scores, row metrics, engine report.

Everything up to the report is an expression over one row, so a document is read once and nothing but sums
per engine and field is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from ..functions.storage import written
from ..functions.text import repair_mojibake
from ..functions.text_pairs import shared_letters
from . import quality

# Labels, keywords and amount forms of the scoring rules.
EDGE = r"[^\p{L}\p{N}_]"
SEPARATORS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
DATE = r"(?:^|[^0-9])([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{2,4})(?:[^0-9]|$)"
CURRENCY = r"₺|(?:^|[^\p{L}\p{N}_])(?:TL|TRY)(?:[^\p{L}\p{N}_]|$)"
INVOICE_WORDS = ("FATURA", "INVOICE", "E-ARSIV", "E-ARŞIV")
RECEIPT_WORDS = ("FIS", "FIŞ", "RECEIPT")
CARD_WORDS = ("KART", "CARD", "VISA", "MASTERCARD")
CASH_WORDS = ("NAKIT", "CASH")
TAX_LABEL = "KDV|VAT|TAX"
SUBTOTAL_LABEL = r"ARA\s+TOPLAM|MATRAH|SUBTOTAL"
DISCOUNT_LABEL = "İNDİRİM|INDIRIM|DISCOUNT"
TOTAL_LABEL = r"GENEL\s+TOPLAM|TOPLAM|TOTAL|ODENECEK|TUTAR"
NOT_TOTAL_LABEL = r"ARA\s+TOPLAM|SUBTOTAL|KDV|VAT|TAX"
HEADER_WORDS = "TARIH|DATE|FIS|FIŞ|FATURA|INVOICE|TOPLAM|TOTAL|KDV|VAT|TAX"
SELLER = r"^(?:SATICI|SELLER|MERCHANT)\s*(?:[ÜüUu]NVAN[Iıİi]|NAME)?\s*[:\-]\s*(.+)$"
NOT_ITEM = (
    r"^(?:TAR[İIıi]H|DATE|SAAT|TIME|F[İIıi]Ş|FIS|FATURA|INVOICE|KDV|TAX|VAT|(?:GENEL\s+|ARA\s+)?TOPLAM|TOTAL|SUBTOTAL|"
    r"[İIıi]ND[İIıi]R[İIıi]M|DISCOUNT|ÖDEME|ODEME|PAYMENT)(?:[^\p{L}\p{N}_]|$)"
)
ITEM_AMOUNT = r"(?:₺\s*)?(?:[0-9]{1,3}(?:[.\s,][0-9]{3})+(?:[,.][0-9]{1,2})?|[0-9]+[,.][0-9]{1,3})(?:\s*(?:TL|TRY))?"
QUANTITY = r"[0-9]+(?:[.,][0-9]+)?\s*(?:ADET|X|×)\s*$"
RATE_TAIL = r"\s+(?:[0-9]+(?:[.,][0-9]+)?\s+)?%\s*[0-9]{1,2}(?:[.,][0-9]+)?\s*$"
MONEY = ("total", "tax", "subtotal", "discount")
FIELDS = ("date", "currency", "documentType", "paymentMethod", "tax", "subtotal", "discount", "total", "merchant")
MARKERS = "ÃÄÅâ"


def normal(text: Column) -> Column:
    """Upper case, currency signs as one word, white space as one blank."""
    marked = F.replace(F.replace(F.upper(text), F.lit("₺"), F.lit(" TL ")), F.lit("TRY"), F.lit(" TL "))
    return F.trim(F.regexp_replace(marked, r"\s+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def has_word(text: Column, words: str) -> Column:
    """Whether one of the words stands alone. A plain search for a part of each word goes before the pattern."""
    parts = dict.fromkeys(max(w.split(r"\s+"), key=len) for w in words.split("|"))
    return has_any(text, tuple(parts)) & text.rlike(f"(?:^|{EDGE})(?:{words})(?:{EDGE}|$)")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def text_lines(text: Column) -> Column:
    """Trimmed lines that hold something."""
    return F.filter(F.transform(F.split(text, SEPARATORS), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x != "")


def last_of(values: Column) -> Column:
    """The last value that is not null: a fold in which later lines win."""
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))


def longest_amount(line: Column) -> Column:
    """The amount of a line with most digits; of equally long ones the largest."""
    return F.array_max(F.transform(quality.amounts(line), lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))))["a"]


def line_values(line: Column) -> Column:
    """What one line says about the four amounts."""

    def said(amount: Column, upper: Column) -> Column:
        says = lambda label: F.when(has_word(upper, label), amount)
        total = F.when(has_word(upper, TOTAL_LABEL) & ~has_word(upper, NOT_TOTAL_LABEL), amount)
        return F.struct(says(TAX_LABEL).alias("tax"), says(SUBTOTAL_LABEL).alias("subtotal"), says(DISCOUNT_LABEL).alias("discount"), total.alias("total"))

    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("tax", "subtotal", "discount", "total")])
    read = let(longest_amount(line), lambda a: F.when(a.isNotNull(), let(normal(line), lambda upper: said(a, upper))).otherwise(none))
    # most lines have no digit and so no amount
    return F.when(line.rlike("[0-9]"), read).otherwise(none)


def structured_fields(rows: DataFrame, text: str = "text", hint: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` plus the fields that the scoring rules read from ``text``, null where they find none.

    Amounts are digits only and the last line that names one wins; the date and the merchant are the first found.
    Where the total is not above the subtotal although a tax was read, it is worked out from the parts."""
    repaired = F.coalesce(repair_mojibake(F.col(text), MARKERS), F.lit(""))
    hinted = F.lit(None).cast("string") if hint is None else F.when(~F.col(hint).isin("", "unknown"), F.col(hint))
    read = rows.select(*keep, repaired.alias("text__"), hinted.alias("hint__"))
    read = read.withColumns({"lines__": text_lines(F.col("text__")), "normal__": normal(F.col("text__"))})
    read = read.withColumn("values__", F.transform("lines__", line_values))
    read = read.withColumn("day__", F.regexp_extract("text__", DATE, 0))
    part = lambda k: F.regexp_extract("day__", DATE, k)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(F.lpad(part(3), 4, "0"))
    day = F.when(part(1) != "", F.concat_ws("-", year, F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
    kind = (
        F.when(has_any(F.col("normal__"), INVOICE_WORDS), "invoice").when(has_any(F.col("normal__"), RECEIPT_WORDS), "receipt")
        .otherwise(F.col("hint__"))
    )
    paid = F.when(has_any(F.col("normal__"), CARD_WORDS), "KART").when(has_any(F.col("normal__"), CASH_WORDS), "NAKIT")
    seller = F.transform("lines__", lambda x: F.nullif(F.trim(F.regexp_extract(x, "(?iu)" + SELLER, 1)), F.lit("")))
    heading = F.filter(F.slice("lines__", 1, 5), lambda x: x.rlike(r"(?:\p{L}\P{L}*+){3}") & ~let(normal(x), lambda n: has_word(n, HEADER_WORDS)))
    # The upper-case form has each of its words as this one.
    lira = F.contains("normal__", F.lit("TL")) & F.col("text__").rlike("(?i)" + CURRENCY)
    first = lambda items: F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))
    found = read.select(
        *keep, day.alias("date"), F.when(lira, "TRY").alias("currency"), kind.alias("documentType"),
        paid.alias("paymentMethod"), *[last_of(F.col("values__")[c]).alias(c) for c in ("tax", "subtotal", "discount", "total")],
        F.coalesce(first(seller), first(heading)).alias("merchant"),
    )
    minor = {c: F.coalesce(F.col(c).try_cast("decimal(38,0)"), F.lit(0)) for c in MONEY}
    sum_of_parts = minor["subtotal"] + minor["tax"] - minor["discount"]
    missed = (minor["subtotal"] > 0) & (minor["tax"] > 0) & (sum_of_parts > minor["subtotal"]) & (minor["total"] <= minor["subtotal"])
    return found.withColumn("total", F.when(missed, sum_of_parts.cast("string")).otherwise(F.col("total")))


def line_item(line: Column) -> Column:
    """Description and amount of one line, null where it is no item."""
    marked = F.regexp_replace(line, "(?iu)(?<![%0-9])" + ITEM_AMOUNT, "\u0001$0\u0002")

    def parsed(m: Column) -> Column:
        plain = lambda c: F.translate(c, "\u0001\u0002", "")
        cut = lambda c, mark, n: F.call_function("substring_index", c, F.lit(mark), n if isinstance(n, Column) else F.lit(n))
        first, parts = cut(m, "\u0001", 1), F.size(F.split(m, "\u0001"))
        counted = (parts > 2) & first.rlike("(?iu)" + QUANTITY)
        before = F.when(counted, F.regexp_replace(first, "(?iu)" + QUANTITY, "")).otherwise(
            plain(cut(m, "\u0001", parts - 1)))
        name = F.trim(F.regexp_replace(F.regexp_replace(before, r"^\s+|\s+$", ""), RATE_TAIL, ""), F.lit(" -:"))
        amount = digits(cut(cut(m, "\u0001", -1), "\u0002", 1))
        return F.when(F.contains(m, F.lit("\u0001")) & (F.length(name) >= 2), F.struct(name.alias("description"), amount.alias("amount")))

    return F.when(line.rlike("[0-9]") & ~line.rlike("(?iu)" + NOT_ITEM), let(marked, parsed))


def scored_items(text: Column) -> Column:
    """All items of a text in line order."""
    return F.filter(F.transform(text_lines(F.coalesce(repair_mojibake(text, MARKERS), F.lit(""))), line_item), lambda x: x.isNotNull())


def candidates(field: Column, value: Column) -> Column:
    """Texts any of which stands for an expected value."""
    day = F.split(value, "-", 3)
    dated = (field == "date") & (F.size(day) == 3)
    comma = F.replace(value, F.lit("."), F.lit(","))
    other = (
        F.when(dated, F.array(F.concat_ws(".", day[2], day[1], day[0]), F.concat_ws("/", day[2], day[1], day[0])))
        .when(field == "total", F.array(comma, F.concat(comma, F.lit(" TL"))))
        .when((field == "documentType") & (F.lower(value) == "receipt"), F.array(*[F.lit(w) for w in ("FIS", "FİŞ", "FIŞ", "FİS")]))
        .when((field == "documentType") & (F.lower(value) == "invoice"), F.array(*[F.lit(w) for w in ("FATURA", "E-ARŞİV", "E-ARSIV")]))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.transform(F.concat(F.array(value), other), normal)


def field_counts(expected: Column, predicted: Column) -> Column:
    """Per expected field: hits, false finds and misses; a blank expectation only counts a false find.

    Both are maps of field to text. A value found beside the truth's fields is not judged."""

    def judged(entry: Column) -> Column:
        field, want, got = entry["key"], entry["value"], F.try_element_at(predicted, entry["key"])
        blank = F.coalesce(F.trim(want), F.lit("")) == ""
        texts = lambda said: F.exists(candidates(field, want), lambda c: (c == said) | ((c != "") & F.contains(said, c)))
        same = F.when(field.isin(*MONEY), digits(normal(want)) == digits(normal(got))).otherwise(let(normal(got), texts))
        number = lambda c: c.cast("long")

        def counted(hit: Column) -> Column:
            false_find = F.when(blank, F.coalesce(got, F.lit("")) != "").otherwise(got.isNotNull() & ~hit)
            return F.struct(field.alias("field"), number(hit).alias("tp"), number(false_find).alias("fp"), number(~blank & ~hit).alias("fn"))

        return let(F.coalesce(~blank & got.isNotNull() & same, F.lit(False)), counted)

    counted = F.transform(F.map_entries(expected), judged)
    return F.filter(counted, lambda c: c["tp"] + c["fp"] + c["fn"] > 0)


def item_counts(expected: Column, predicted: Column) -> Column:
    """Hits, false finds and misses of items matched one to one; null without expected items."""
    key = lambda i: F.concat_ws("\u0001", normal(i["description"]), digits(i["amount"]))

    def counted(keys: Column) -> Column:
        want, got = keys["want"], keys["got"]
        copies = lambda a, k: F.size(F.filter(a, lambda x: x == k))
        hits = F.aggregate(F.array_distinct(want), F.lit(0), lambda n, k: n + F.least(copies(want, k), copies(got, k)))
        return F.struct(hits.cast("long").alias("tp"), (F.size(got) - hits).cast("long").alias("fp"), (F.size(want) - hits).cast("long").alias("fn"))

    pair = F.struct(F.transform(expected, key).alias("want"), F.transform(predicted, key).alias("got"))
    return F.when(F.size(expected) > 0, let(pair, counted))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal(text), " "), lambda w: w != ""))


def special_counts(reference: Column, prediction: Column, letters: str) -> Column:
    """Precision, recall and F1 of special letters taken as bags; two empty bags are perfect."""
    shares = lambda n: F.struct(quality.ratio(n["hits"], n["b"]).alias("p"), quality.ratio(n["hits"], n["a"]).alias("r"), (n["a"] + n["b"]).alias("n"))
    perfect = F.struct(F.lit(1.0).alias("precision"), F.lit(1.0).alias("recall"), F.lit(1.0).alias("f1"))
    scores = lambda s: F.when(s["n"] == 0, perfect).otherwise(F.struct(s["p"].alias("precision"), s["r"].alias("recall"), quality.f1(s["p"], s["r"]).alias("f1")))
    return let(let(shared_letters(letters)(reference, prediction), shares), scores)


def benchmark_rows(runs: DataFrame, keep: tuple[str, ...] = ("sample_id", "engine"), letters: str = quality.SPECIAL_LETTERS) -> DataFrame:
    """One scored row per run of an engine on a sample.

    ``runs`` have ``reference``, ``prediction``, ``document_type``, ``fields`` (map), ``snippets`` and
    ``line_item_amounts`` (arrays), ``line_items`` (array of description and amount), ``confidence``,
    ``latency_ms``, ``error_code`` and ``warning_codes``. A run that failed keeps its latency only. The scored rows
    are written, as every report reads them several times and none should read the texts again."""
    clash = {c for c in runs.columns if c.lower() in {f.lower() for f in FIELDS}}
    carried = [c for c in runs.columns if c not in clash]
    read = structured_fields(runs, "prediction", "document_type", tuple(carried))
    found = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("k"), F.col(f).alias("v")) for f in FIELDS]), lambda e: e["v"].isNotNull()))
    good, ref, hyp = F.col("error_code").isNull(), F.col("reference"), F.col("prediction")
    any_amount = F.size("ref_amounts") + F.size("hyp_amounts") > 0
    ready = read.select(*carried, found.alias("predicted_fields"), scored_items(hyp).alias("predicted_items"), normal(hyp).alias("said"),
                        quality.amounts(ref).alias("ref_amounts"), quality.amounts(hyp).alias("hyp_amounts"))
    share = lambda items, part: F.when(F.size(items) > 0, F.size(F.filter(items, part)) / F.size(items))
    scores = {
        "cer": quality.cer(ref, F.trim(hyp)), "wer": quality.wer(ref, F.trim(hyp)),
        "snippet_recall": share(F.col("snippets"), lambda s: F.contains(F.col("said"), normal(s))),
        "token": quality.set_prf(token_set(ref), token_set(hyp)), "special": special_counts(ref, hyp, letters),
        "amount": F.when(any_amount, quality.set_prf(F.col("ref_amounts"), F.col("hyp_amounts"))),
        "line_item_amount_recall": share(F.col("line_item_amounts"), lambda a: F.contains(digits(F.col("said")), digits(a))),
        "item_counts": item_counts(F.col("line_items"), F.col("predicted_items")),
        "field_counts": field_counts(F.col("fields"), F.col("predicted_fields")),
    }
    rows = ready.select(
        *keep, "error_code", "latency_ms", F.when(good, F.col("confidence")).alias("confidence"), F.when(good, F.col("warning_codes")).alias("warning_codes"),
        F.when(good, F.col("predicted_fields")).alias("predicted_fields"), *[F.when(good, v).alias(c) for c, v in scores.items()],
    )
    return written(rows, "scored-runs")


def precision_recall(df: DataFrame, prefix: str = "") -> DataFrame:
    """``precision``, ``recall`` and ``f1`` from ``tp``, ``fp`` and ``fn``; null where nothing was judged."""
    tp, fp, fn = (F.col(prefix + c) for c in ("tp", "fp", "fn"))
    judged = lambda value: F.when(tp + fp + fn > 0, value)
    p, r = quality.ratio(tp, tp + fp), quality.ratio(tp, tp + fn)
    return df.withColumns({f"{prefix}precision": judged(p), f"{prefix}recall": judged(r), f"{prefix}f1": judged(quality.f1(p, r))})


def field_report(scored: DataFrame, keys: tuple[str, ...] = ("engine",)) -> DataFrame:
    """Per ``keys`` and field: counts, precision, recall and F1 over all scored rows."""
    each = scored.where(F.col("error_code").isNull()).select(*keys, F.explode("field_counts").alias("c")).select(*keys, "c.*")
    return precision_recall(each.groupBy(*keys, "field").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def field_summary(fields: DataFrame, keys: tuple[str, ...] = ("engine",)) -> DataFrame:
    """Pooled and averaged scores of all fields from ``field_report``."""
    sums = fields.groupBy(*keys).agg(
        *[F.sum(c).alias(f"field_{c}") for c in ("tp", "fp", "fn")], *[F.avg(c).alias(f"field_macro_{c}") for c in ("precision", "recall", "f1")])
    return precision_recall(sums, "field_")


def calibration_error(scored: DataFrame) -> DataFrame:
    """Expected calibration error and Brier score of each engine, from sums per confidence bucket."""
    rows = scored.where(F.col("confidence").isNotNull() & F.col("error_code").isNull()).select(
        "engine", "confidence", (F.lit(1.0) - F.least("cer", F.lit(1.0))).alias("quality"), quality._bucket(F.col("confidence")).alias("bucket"))
    sums = rows.groupBy("engine", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"), F.sum("quality").alias("q"), F.sum(F.pow(F.col("confidence") - F.col("quality"), 2)).alias("b"))
    return sums.groupBy("engine").agg(
        (F.sum(F.when(F.col("bucket").isNotNull(), F.abs(F.col("c") - F.col("q")))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"))


def code_counts(scored: DataFrame) -> DataFrame:
    """Warning codes of each engine with their counts, as ``CODE=n`` in order."""
    codes = scored.where(F.col("error_code").isNull()).select("engine", F.explode("warning_codes").alias("code"))
    counted = codes.groupBy("engine", "code").agg(F.count(F.lit(1)).alias("n"))
    named = F.concat_ws("=", "code", F.col("n").cast("string"))
    return counted.groupBy("engine").agg(F.array_join(F.array_sort(F.collect_list(named)), ",").alias("warning_counts"))


def engine_report(scored: DataFrame) -> DataFrame:
    """All metrics of each engine from scored rows: one pass for rows, one for fields, small joins per engine."""
    good = F.col("error_code").isNull()
    low = (F.col("cer") > 0.5) | F.coalesce(F.col("snippet_recall") < 0.4, F.lit(False))
    means = {
        "average_cer": "cer", "average_wer": "wer", "snippet_recall": "snippet_recall",
        **{f"{kind}_{m}": f"{kind}.{m}" for kind in ("token", "special", "amount") for m in ("precision", "recall", "f1")},
        "line_item_amount_recall": "line_item_amount_recall", "average_confidence": "confidence",
    }
    sums = scored.groupBy("engine").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"),
        (F.count_if(~good) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("failure_rate"),
        *[F.avg(c).alias(name) for name, c in means.items()], F.avg(F.when(good, F.col("latency_ms"))).alias("average_latency_ms"),
        *[F.coalesce(F.sum(f"item_counts.{c}"), F.lit(0)).alias(f"line_item_{c}") for c in ("tp", "fp", "fn")], F.count("item_counts").alias("judged__"),
        F.count_if(good & (F.col("confidence") >= 0.75) & low).alias("high_confidence_wrong"),
        F.array_join(F.array_sort(F.collect_set("error_code")), ",").alias("failure_codes"),
    )
    items = {c: F.when(F.col("judged__") > 0, F.coalesce(F.col(c), F.lit(0.0))) for c in ("line_item_precision", "line_item_recall", "line_item_f1")}
    report = precision_recall(sums, "line_item_").withColumns(items).drop("judged__")
    for more in (field_summary(field_report(scored)), calibration_error(scored), code_counts(scored)):
        report = report.join(more, "engine", "left")
    return report.withColumns({
        "status": F.when(F.col("succeeded") > 0, "ok").otherwise("failed"), "warning_counts": F.coalesce("warning_counts", F.lit("")),
        **{f"field_{c}": F.coalesce(f"field_{c}", F.lit(0)) for c in ("tp", "fp", "fn")},
    })


def accuracy_by_variant(scored: DataFrame, variant: str) -> DataFrame:
    """Share of judged fields that were hit, per variant and field, the variant's own means beside it."""
    each = scored.where(F.col("error_code").isNull())
    fields = each.select(variant, F.explode("field_counts").alias("c")).where("c.tp + c.fn > 0").groupBy(variant, F.col("c.field").alias("field")).agg(
        F.sum(F.col("c.tp") + F.col("c.fn")).alias("samples"), F.sum("c.tp").alias("hits"))
    overall = each.groupBy(variant).agg(F.count(F.lit(1)).alias("rows"), F.avg("cer").alias("average_cer"), F.avg("wer").alias("average_wer"))
    return fields.join(overall, variant).withColumn("accuracy", F.col("hits") / F.col("samples"))

