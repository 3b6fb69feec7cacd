"""Training-row curation: filters, splits, hard cases, balanced samples, boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import groups
from ..functions.binding import let
from ..functions.storage import written
from ..functions.text import mask, mask_json

# Letters, confusable characters, row patterns and sample weights.
SPECIAL_LETTERS = "çğıİöşüÇĞIÖŞÜ"
SPECIAL_LETTERS_LINE = "çğıİöşüÇĞÖŞÜ"
CONFUSABLE = "Iİıil1OÖ0SŞ5GĞcçuü,.;:₺"
FIELD_WORDS = (
    r"(?i)\b(toplam|total|tutar|amount|kdv|vat|tax|ara\s*toplam|subtotal|fatura|invoice|fiş|fis|receipt|tarih|date"
    r"|saat|time|vkn|tckn|iban)\b"
)
AMOUNT = r"(?i)(?:[0-9]{1,3}(?:[. ][0-9]{3})*|[0-9]+)[,.][0-9]{2}(?:\s*(?:TL|TRY|₺|EUR|€|USD|\$))?"
DATE_OR_TIME = r"(?:\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\b|\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\b)"
DATE_ONLY = r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\b"
IDENTIFIER = (
    r"(?i)(?:\b(?:IBAN|VKN|TCKN|FİŞ\s*NO|FIS\s*NO|FATURA\s*NO|BELGE\s*NO|REF(?:ERANS)?\s*NO)\b"
    r"|\bTR[0-9]{2}[A-Z0-9]{8,}\b)"
)
IDENTIFIER_WORDS = ("iban", "vkn", "tckn", "fis", "fatura", "belge", "ref")
KEY_FIELD_PREFIXES = ("FİŞ NO", "FATURA NO", "VKN ", "TARİH ", "ARA TOPLAM ", "KDV ", "TOPLAM ")
PRIORITY_SOURCES = ("OCRTurk", "project_fixture_real_crop", "project_fixture_synthetic")
SOURCE_WEIGHTS = {
    "CORD": 1.0, "SROIE": 1.15, "OCRTurk": 1.6, "project_fixture_synthetic": 1.25, "project_fixture_real_crop": 2.0,
}
TASK_WEIGHTS = {
    "key_field": 1.35, "amount": 1.4, "date_or_time": 1.25, "identifier": 1.25, "turkish_special": 1.5,
    "long_line": 1.35, "hardcase": 1.25,
}


def usable_rows(manifest: DataFrame, sources: tuple[str, ...] | None = None) -> DataFrame:
    rows = manifest.where(F.col("usable_for_training") & (F.trim(F.coalesce("image", F.lit(""))) != ""))
    return rows.where(F.col("source").isin(*sources)) if sources else rows


def label_filters(manifest: DataFrame) -> DataFrame:
    """Labels without replacement characters, 2..140 long, two letters or digits, a four-value box."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    return manifest.where(
        ~F.contains("text", F.lit("�")) & F.length("text").between(2, 140) & (letters >= 2) & (F.size("box") == 4)
    )


def confusable_lines(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.length(F.regexp_replace("text", f"[^{CONFUSABLE}]", "")) >= 2)


def _present(*codes: Column) -> Column:
    return F.array_sort(F.filter(F.array(*codes), lambda c: c.isNotNull()))


def hardcase_reasons(text: Column, source: Column, field_keys: Column) -> Column:
    return _present(
        F.when(text.rlike(f"[{SPECIAL_LETTERS}]"), "turkish_special_character"),
        F.when(text.rlike(AMOUNT), "amount_or_decimal_comma"),
        F.when(text.rlike(DATE_ONLY), "date_pattern"),
        F.when(text.rlike(FIELD_WORDS), "field_keyword"),
        F.when(F.length(F.regexp_replace(text, f"[^{CONFUSABLE}]", "")) >= 2, "hard_character_confusion"),
        F.when(source.isin(*PRIORITY_SOURCES), "priority_turkish_or_project_source"),
        F.when(F.arrays_overlap(field_keys, F.array(*[F.lit(k) for k in (
            "category", "entities", "lineItem", "expectedOcrTextSnippets")])), "layout_or_extraction_field"),
    )


def hardcase_mining(manifest: DataFrame) -> DataFrame:
    """Usable rows with at least one reason, their weight and stable id; one row per id."""
    reasons = hardcase_reasons(F.col("text"), F.col("source"), F.col("field_keys"))
    rows = usable_rows(manifest).withColumn("reasons", reasons).where(F.size("reasons") > 0)
    weight = F.least(F.lit(4), 1 + F.floor(F.size("reasons") / 2)).cast("int")
    first = rows.groupBy("id").agg(F.min(F.struct("source", "split", "text", "reasons", weight.alias("weight"))).alias("row"))
    return first.select("id", "row.*").select(
        F.concat(F.col("id").cast("string"), F.lit(":hardcase")).alias("id"), "source", "split", "text", "reasons", "weight",
    )


def reason_counts(hardcases: DataFrame) -> DataFrame:
    return hardcases.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


def hardcase_merge(base: DataFrame, mined: DataFrame) -> DataFrame:
    """Mined rows joined into the base by identity: reasons united, weights capped 1..4.

    Rows with a ``crop`` box are the same only where their boxes are; a row without one matches its like."""
    identity = ["source", "split", "image", *(["crop"] if "crop" in base.columns else []), "text_key"]
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    both = base.unionByName(mined).withColumn("text_key", key)
    # Reasons are a short fixed vocabulary, so the set per identity stays small.
    return both.groupBy(*identity).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
        F.greatest(F.lit(1), F.least(F.lit(4), F.max("weight"))).alias("weight"),
    )


def task_labels(text: Column, hardcase: Column) -> Column:
    trimmed = F.trim(text)
    starts = lambda u: reduce(lambda a, b: a | b, [F.startswith(u, F.lit(p)) for p in KEY_FIELD_PREFIXES])
    key_field = let(F.upper(F.translate(trimmed, "ı", "I")), starts)
    # What every match of a pattern holds is looked for first: most lines hold none of it.
    digit, beyond_ascii = trimmed.rlike("[0-9]"), F.octet_length(trimmed) > F.length(trimmed)
    says = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in IDENTIFIER_WORDS])
    named = F.contains(trimmed, F.lit("Ş")) | let(F.lower(trimmed), lambda low: says(low) | (F.contains(low, F.lit("tr")) & digit))
    found = _present(
        F.when(key_field, "key_field"), F.when(digit & trimmed.rlike(AMOUNT), "amount"),
        F.when(digit & trimmed.rlike(DATE_OR_TIME), "date_or_time"), F.when(named & trimmed.rlike(IDENTIFIER), "identifier"),
        F.when(beyond_ascii & trimmed.rlike(f"[{SPECIAL_LETTERS_LINE}]"), "turkish_special"),
        F.when(F.length(trimmed) > 40, "long_line"), F.when(hardcase, "hardcase"),
    )
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("general_text"))))


def _lookup(weights: dict[str, float], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(1.0))


def sampling_weights(
    manifest: DataFrame, source_weights: dict[str, float] = SOURCE_WEIGHTS, task_weights: dict[str, float] = TASK_WEIGHTS,
    field_factor: float = 1.0, maximum: float = 8.0,
) -> DataFrame:
    """Task labels and the clamped product of source, task, key-field and hard-case weights."""
    labels = task_labels(F.col("text"), F.size("reasons") > 0)
    rows = manifest.withColumn("labels", labels)
    product = F.aggregate("labels", _lookup(source_weights, F.col("source")), lambda a, l: a * _lookup(task_weights, l))
    has = lambda l: F.array_contains("labels", l)
    hard = F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce("hardcase_weight", F.lit(1))))
    weight = product * F.when(has("key_field"), field_factor).otherwise(1.0) * F.when(has("hardcase"), hard).otherwise(1)
    bounded = F.least(F.lit(maximum), F.greatest(F.lit(1.0), weight))
    return rows.withColumn("weight", F.round(bounded, 6))


def weighted_shares(weighted: DataFrame) -> DataFrame:
    """Expected share of the sample by source and by task label.

    One pass: sums by source and label list are written, and all shares are taken from them."""
    fine = written(weighted.groupBy("source", "labels").agg(F.sum("weight").alias("w")), "shares")
    total = fine.agg(F.sum("w").alias("__all")).withColumn("__one", F.lit(1))
    by_source = fine.groupBy(F.lit("source").alias("kind"), F.col("source").alias("value")).agg(F.sum("w").alias("w"))
    by_task = fine.select("w", F.explode("labels").alias("value")).groupBy(F.lit("task").alias("kind"), "value").agg(F.sum("w").alias("w"))
    joined = by_source.unionByName(by_task).withColumn("__one", F.lit(1)).join(total, "__one")
    return joined.select("kind", "value", F.round(F.col("w") / F.col("__all"), 6).alias("share"))


def dataset_mix(manifest: DataFrame, columns: tuple[str, ...] = ("source", "split", "document_type", "level"), lists: tuple[str, ...] = ("reasons", "labels")) -> DataFrame:
    """Row counts by every value of ``columns`` and every member of the arrays ``lists``, as far as they are there.

    Rows are counted per combination of the plain columns first; members of arrays count once a row."""
    columns = [c for c in columns if c in manifest.columns]
    fine = manifest.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in columns])
    counts = fine.select(F.explode(parts).alias("p"), "n").groupBy("p.kind", "p.value").agg(F.sum("n").alias("count"))
    for name in [c for c in lists if c in manifest.columns]:
        members = manifest.select(F.explode(F.array_distinct(name)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        counts = counts.unionByName(members.select(F.lit(name).alias("kind"), "value", "count"))
    return counts


def bounded_split_sample(rows: DataFrame, samples: int, seed: int, share: float = 0.15) -> DataFrame:
    """At most ``samples`` rows of both splits, ``share`` of them validation, each split balanced over its sources.

    A split that is short gives its places to the other. Both splits must have rows."""
    sizes = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).where(F.col("split").isin("train", "validation")).collect()}
    train, validation = sizes.get("train", 0), sizes.get("validation", 0)
    if not train or not validation or samples <= 0:
        raise ValueError("a bounded sample needs a positive size and rows of both splits")
    if train + validation > samples:
        held = max(1, min(validation, round(samples * share)))
        taught = max(1, samples - held)
        if taught > train:
            held, taught = min(validation, held + taught - train), train
        train, validation = (max(0, samples - held) if taught + held > samples else taught), held
    parts = [source_balanced_sample(rows.where(F.col("split") == name), n, seed) for name, n in (("train", train), ("validation", validation)) if n]
    return reduce(DataFrame.unionByName, parts)


def hash_order(seed: int, kind: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(f"{kind}:{seed}"), *columns), 256)


def source_balanced_sample(rows: DataFrame, target: int, seed: int) -> DataFrame:
    """About equal shares per source, topped up from the overflow.

    Hash order replaces a random shuffle, so the choice is repeatable. A histogram of
    65,536 hash buckets per source gives, before any row moves, the bucket at which the
    quota of a source and the overflow are surely reached. Rows beyond it are filtered
    in the scan, and only the few that are left are ranked."""
    hashed = rows.withColumn("__h", hash_order(seed, "row", "id")).withColumn("__b", F.substring("__h", 1, 4))
    # A running count over the buckets of one source: 65,536 rows at most.
    before = F.sum("__n").over(W.partitionBy("source").orderBy("__b")) - F.col("__n")
    cells = hashed.groupBy("source", "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", before)
    sizes = cells.groupBy("source").agg(F.sum("__n").alias("__size"))
    # The place of a source among the sources by name; one row per source.
    place = F.row_number().over(W.orderBy("source")) - 1
    share = F.lit(target) / F.count(F.lit(1)).over(W.partitionBy())
    odd = F.lit(target) % F.count(F.lit(1)).over(W.partitionBy())
    quotas = sizes.select("source", "__size", (F.floor(share) + F.when(place < odd, 1).otherwise(0)).alias("__quota"))
    need = (F.lit(target) - F.sum(F.least("__quota", "__size"))).alias("__need")
    total = quotas.agg(need)
    planned = cells.join(quotas.select("source", "__quota"), "source")
    over = F.col("__n") - F.greatest(F.lit(0), F.least(F.col("__n"), F.col("__quota") - F.col("__before")))
    # Overflow of all sources per bucket: 65,536 rows at most.
    spare = planned.groupBy("__b").agg(F.sum(over).alias("__n"))
    spare = spare.withColumn("__before", F.sum("__n").over(W.orderBy("__b")) - F.col("__n"))
    spare_cut = spare.join(total, F.col("__before") < F.col("__need")).agg(F.max("__b").alias("__spare_cut"), F.max("__need").alias("__need"))
    own_cut = planned.where(F.col("__before") < F.col("__quota")).groupBy("source").agg(
        F.max("__b").alias("__own_cut"), F.max("__quota").alias("__quota"))
    # One row per source; a source without quota is reached by the overflow alone.
    cuts = quotas.select("source").join(own_cut, "source", "left").join(spare_cut)
    reached = F.coalesce(F.col("__b") <= F.col("__own_cut"), F.lit(False)) | F.coalesce(F.col("__b") <= F.col("__spare_cut"), F.lit(False))
    near = hashed.join(cuts, "source").where(reached)
    ranked = near.withColumn("__rank", F.row_number().over(W.partitionBy("source").orderBy("__h", "id")))
    inside = F.col("__rank") <= F.coalesce("__quota", F.lit(0))
    chosen = ranked.where(inside)
    # A distributed top-k of the target at most, then the part of it that is needed.
    spared = ranked.where(~inside).orderBy("__h", "id").limit(target)
    refill = spared.withColumn("__rank", F.row_number().over(W.orderBy("__h", "id"))).where(F.col("__rank") <= F.col("__need"))
    columns = rows.columns
    return chosen.select(*columns, F.lit("quota").alias("reason")).unionByName(
        refill.select(*columns, F.lit("overflow").alias("reason")))


def document_balanced_sample(rows: DataFrame, documents: int, lines: int, seed: int, offset: int = 0) -> DataFrame:
    """Hash-ranked documents (an offset and a maximum), then hash-ranked lines of each."""
    docs = rows.select("doc_id").distinct().withColumn("__d", hash_order(seed, "document", "doc_id"))
    # Top offset + maximum over all documents: a distributed top-k.
    first = docs.orderBy("__d", "doc_id").limit(offset + documents).withColumn("__one", F.lit(1))
    ranked = first.withColumn("document_rank", F.row_number().over(W.partitionBy("__one").orderBy("__d", "doc_id")))
    picked = ranked.where(F.col("document_rank") > offset).select("doc_id", F.col("document_rank").cast("long"))
    inside = rows.join(picked, "doc_id").withColumn("__l", hash_order(seed, "line", "id"))
    return groups.top(inside, ["doc_id"], [F.asc("__l"), F.asc("id")], lines, "line_rank").drop("__l")


def ratio_split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """70/15/15 by position in each class; classes of at most two rows are test."""
    sized = groups.positions(rows, keys, [F.asc("id")], size="__n")
    share = (F.col("position") - 1) / F.col("__n")
    split = (
        F.when(F.col("__n") <= 2, "test").when(share < 0.7, "train").when(share < 0.85, "validation").otherwise("test")
    )
    return sized.withColumn("split", split).drop("__n", "position")


def fifth_document_split(rows: DataFrame) -> DataFrame:
    """Every fifth document (in id order) goes to validation; a single document trains."""
    docs = rows.select("source", "doc_id").distinct()
    sized = groups.positions(docs, ["source"], [F.asc("doc_id")], size="__n")
    held = (F.col("__n") > 1) & ((F.col("position") - 1) % 5 == 4)
    return sized.select("source", "doc_id", F.when(held, "validation").otherwise("train").alias("split"))


def numeric_tokens(rows: DataFrame) -> DataFrame:
    """Numeric words with their offset, brackets and currency marks removed."""
    parts = rows.select("id", F.posexplode(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).alias("word_no", "w"))
    token = F.regexp_replace("w", r"^[()\[\]{}:;]+|[()\[\]{}:;]+$", "")
    token = F.trim(F.regexp_replace(F.regexp_replace(token, r"^₺?\$?", ""), r"TL(TRY)?$|TRY$", ""))
    return parts.select("id", "word_no", token.alias("token")).where(
        F.col("token").rlike(r"^(?:[0-9]+(?:[,.][0-9]+)+|[0-9]{2,})$")
    )


def normalise_boxes(box: DataFrame) -> DataFrame:
    """Both box layouts to corner form; empty boxes are dropped."""
    xywh = F.col("format") == "xywh"
    corners = box.select(
        *[c for c in box.columns if c not in ("a", "b", "c", "d", "format")],
        F.col("a").alias("x1"), F.col("b").alias("y1"),
        F.when(xywh, F.col("a") + F.col("c")).otherwise(F.col("c")).alias("x2"),
        F.when(xywh, F.col("b") + F.col("d")).otherwise(F.col("d")).alias("y2"),
    )
    return corners.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def reading_order(box: DataFrame) -> DataFrame:
    """Boxes of a page by vertical centre, then left edge."""
    centre = F.col("y1") + F.floor((F.col("y2") - F.col("y1")) / 2)
    return groups.positions(
        box.withColumn("__c", centre), ["doc_id", "kind"], [F.asc(c) for c in ("__c", "x1", "ord", "x2", "y2")],
        "reading_position",
    ).drop("__c")


def box_pairs(box: DataFrame, cell: int = 128) -> DataFrame:
    """Overlapping truth × predicted boxes of one document with their IoU and the share of each that is covered.

    Boxes meet through the grid cells they touch, so only neighbours are ever
    paired; pairs without overlap have IoU 0 and no later step reads them."""
    cells = F.explode(F.sequence(F.floor(F.col("x1") / cell), F.floor((F.col("x2") - 1) / cell)))
    rows = F.explode(F.sequence(F.floor(F.col("y1") / cell), F.floor((F.col("y2") - 1) / cell)))
    tiled = box.withColumn("__cx", cells).withColumn("__cy", rows)

    def side(kind: str, p: str) -> DataFrame:
        return tiled.where(F.col("kind") == kind).select(
            "doc_id", "__cx", "__cy", *[F.col(c).alias(f"{p}_{c}") for c in ("ord", "x1", "y1", "x2", "y2")])

    pairs = side("truth", "t").join(side("pred", "p"), ["doc_id", "__cx", "__cy"])
    left, upper = F.greatest("t_x1", "p_x1"), F.greatest("t_y1", "p_y1")
    width, height = F.least("t_x2", "p_x2") - left, F.least("t_y2", "p_y2") - upper
    # A pair sharing several cells counts in the cell of its overlap's corner only.
    home = (F.floor(left / cell) == F.col("__cx")) & (F.floor(upper / cell) == F.col("__cy"))
    area = lambda p: (F.col(f"{p}_x2") - F.col(f"{p}_x1")) * (F.col(f"{p}_y2") - F.col(f"{p}_y1"))
    overlap = width * height
    return pairs.where((width > 0) & (height > 0) & home).select(
        "doc_id", F.col("t_ord").alias("truth"), F.col("p_ord").alias("pred"),
        (overlap / (area("t") + area("p") - overlap)).alias("iou"),
        (overlap / area("t")).alias("truth_covered"), (overlap / area("p")).alias("pred_covered"),
    )


def greedy_matches(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one matches of each document by falling IoU, ties by truth, then prediction.

    The sequential choice is made in rounds without a group per document: a pair that is the best one left of
    both its boxes would be reached before any pair that touches it, so it is a match; its boxes then leave.
    Every round matches at least the best pair of each cluster of touching boxes. What is left after a round is
    written, and the rounds end when nothing is. Two boxes under one number count as one, with their best overlap."""
    near = pairs.where(F.col("iou") >= threshold).repartition("doc_id", "truth")
    left = near.groupBy("doc_id", "truth", "pred").agg(F.max("iou").alias("iou"))
    found = []
    while True:
        rank = F.struct(-F.col("iou"), F.col("truth"), F.col("pred"))
        best = lambda side: F.min(rank).over(W.partitionBy("doc_id", side)) == rank
        touched = lambda side: F.max(F.col("__hit").cast("int")).over(W.partitionBy("doc_id", side)) == 1
        # Steps by one side follow each other, so that rows are dealt three times and carry flags only.
        hit = left.withColumn("__hit", best("truth")).withColumn("__hit", F.col("__hit") & best("pred"))
        judged = written(hit.withColumn("__gone_p", touched("pred")).withColumn("__gone_t", touched("truth")), "matches")
        found.append(judged.where("__hit").select("doc_id", "truth", "pred", "iou"))
        left = judged.where("NOT __gone_t AND NOT __gone_p").select("doc_id", "truth", "pred", "iou")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


#: Matches of a document whose order is counted inside one row.
FEW_MATCHES = 64


def ordered_pairs(matches: DataFrame, chunk: int = 4096) -> DataFrame:
    """``doc_id``, pairs of matches, and how many keep the order of truth and prediction.

    Documents of few matches are one array each and are counted in their row, so their matches are shuffled once."""
    sizes = matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    few = groups.join_null_safe(matches.select("doc_id", "truth", "pred"), sizes.where(F.col("n") <= FEW_MATCHES), ["doc_id"], "inner")
    rows = few.groupBy("doc_id", "pairs").agg(F.sort_array(F.collect_list(F.struct("truth", F.struct("pred").alias("pred")))).alias("__a"))
    later = lambda i: F.slice("__a", i + 2, F.size("__a"))
    kept = F.transform("__a", lambda a, i: F.size(F.filter(later(i), lambda b: a["pred"] < b["pred"])))
    counted = rows.select("doc_id", "pairs", F.aggregate(kept, F.lit(0).cast("long"), lambda n, k: n + k).alias("in_order"))
    many = sizes.where(F.col("n") > FEW_MATCHES).select("doc_id")
    if many.isEmpty():
        return counted
    return counted.unionByName(_ordered_pairs(groups.join_null_safe(matches.select("doc_id", "truth", "pred"), many, ["doc_id"], "inner"), chunk))


def _ordered_pairs(matches: DataFrame, chunk: int) -> DataFrame:
    """``ordered_pairs`` of documents with any number of matches.

    Inversions are counted bit by bit: at the highest bit in which two prediction ranks differ, the pair is in
    order if the earlier truth has a 0 and the later a 1. A match takes part once per bit of its document, in the
    group of ranks that share all higher bits; the zeros before it are running counts inside a chunk of truth
    ranks plus those of the chunks before, so no task holds a document."""
    by_pred = groups.positions(matches.select("doc_id", "truth", "pred"), ["doc_id"], [F.asc("pred")], "__p")
    ranked = groups.positions(by_pred, ["doc_id"], [F.asc("truth")], "__t", "__m")
    bits = F.length(F.bin(F.col("__m")))
    each = ranked.select("doc_id", "__m", "__t", "__p", F.explode(F.sequence(F.lit(0), bits - 1)).alias("__bit"))
    each = each.select(
        "doc_id", "__bit", "__t", F.call_function("shiftright", F.col("__p"), F.col("__bit") + 1).alias("__high"),
        (F.call_function("shiftright", F.col("__p"), F.col("__bit")) % 2).alias("__one"), F.floor(F.col("__t") / chunk).alias("__chunk"))
    keys = ["doc_id", "__bit", "__high"]
    inside = F.sum(1 - F.col("__one")).over(W.partitionBy(*keys, "__chunk").orderBy("__t").rowsBetween(W.unboundedPreceding, 0))
    zeros = each.groupBy(*keys, "__chunk").agg(F.sum(1 - F.col("__one")).alias("__zeros"))
    earlier = zeros.select(*keys, "__chunk", (F.sum("__zeros").over(W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("__zeros")).alias("__earlier"))
    counted = each.withColumn("__inside", inside).where("__one = 1").join(earlier, [*keys, "__chunk"])
    in_order = counted.groupBy("doc_id").agg(F.sum(F.col("__inside") + F.col("__earlier")).alias("in_order"))
    sizes = ranked.groupBy("doc_id").agg(F.max("__m").alias("n")).select("doc_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    return sizes.join(in_order, "doc_id", "left").select("doc_id", "pairs", F.coalesce("in_order", F.lit(0)).alias("in_order"))


def steady_mean(column: str) -> Column:
    """Mean rounded to six places. The sum is exact and a mean within 1e-12 of a half counts as the half, so that neither
    the order of the rows nor the last bit of a fraction decides."""
    mean = F.sum(F.col(column).cast("decimal(38,18)")).cast("double") / F.count(column)
    return F.round(F.round(mean, 12), 6)


def box_detection_scores(box: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scores of the detected boxes of each document.

    Precision, recall and F1 of the one-to-one matches, mean and median IoU, missed boxes, duplicates, predictions
    that merge two truths or more, truths that are split over two predictions or more, and the share of match
    pairs whose predictions keep the truth's order (1 below two matches)."""
    box = written(box.select("doc_id", "kind", "ord", "x1", "y1", "x2", "y2"), "boxes")
    sizes = box.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "truth").alias("truths"), F.count_if(F.col("kind") == "pred").alias("preds"))
    pairs = written(box_pairs(box), "box-pairs")
    matches = greedy_matches(pairs, threshold)
    hits = matches.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("matched"), steady_mean("iou").alias("mean_iou"),
        F.round(F.percentile("iou", F.lit(0.5)), 6).alias("median_iou"))

    def many_to_one(container: str, covered: str, name: str) -> DataFrame:
        crowded = pairs.where(F.col(covered) >= 0.5).groupBy("doc_id", container).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
        return crowded.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))

    joined = sizes
    for more in (hits, many_to_one("pred", "truth_covered", "merged"), many_to_one("truth", "pred_covered", "split"), ordered_pairs(matches)):
        joined = joined.join(more, "doc_id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("matched", "merged", "split", "pairs", "in_order")})
    m = F.col("matched")
    perfect = lambda other: F.when(F.col(other) == 0, 1.0).otherwise(0.0)
    precision = F.when(F.col("preds") == 0, perfect("truths")).otherwise(m / F.col("preds"))
    recall = F.when(F.col("truths") == 0, perfect("preds")).otherwise(m / F.col("truths"))
    f1 = F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0))
    order = F.when(F.col("pairs") == 0, 1.0).otherwise(F.col("in_order") / F.col("pairs"))
    return joined.select(
        "doc_id", "truths", "preds", "matched", (F.col("truths") - m).alias("missed"), (F.col("preds") - m).alias("duplicates"), "merged", "split",
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"),
        F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"), F.coalesce("median_iou", F.lit(0.0)).alias("median_iou"), F.round(order, 6).alias("order_accuracy"),
    )


def detection_summary(scores: DataFrame) -> DataFrame:
    """All documents together: counts pooled, the rest averaged over documents."""
    counts = ("matched", "missed", "duplicates", "merged", "split")
    sums = scores.agg(
        F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], steady_mean("mean_iou").alias("mean_iou"),
        F.round(F.percentile("median_iou", F.lit(0.5)), 6).alias("median_iou"), steady_mean("order_accuracy").alias("order_accuracy"))
    share = lambda other: F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("matched") + F.col(other)), F.lit(0.0))
    p, r = share("duplicates"), share("missed")
    return sums.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0)), 6)})


def content_dedupe(document: DataFrame) -> DataFrame:
    """Exact copies per tenant: the smallest id survives, others name it."""
    hashed = document.select("id", "tenant_id", F.sha2("text", 256).alias("sha256"))
    first = groups.attach(hashed, ["tenant_id", "sha256"], F.min("id").alias("survivor_id"))
    return first.withColumn("duplicate", F.col("id") != F.col("survivor_id"))


def line_dedupe(document: DataFrame) -> DataFrame:
    """Ordered distinct lines of a text, compared without case and blanks.

    Works inside the row: keys to first positions, then the lines at those."""
    squeezed = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    lines = F.filter(squeezed, lambda x: x != "")
    df = document.withColumn("__lines", lines).withColumn(
        "__keys", F.transform("__lines", lambda x: F.replace(F.lower(x), F.lit(" "), F.lit(""))))
    kept = F.transform(F.array_distinct("__keys"), lambda k: F.get("__lines", (F.array_position("__keys", k) - 1).cast("int")))
    return df.withColumn("__kept", kept).select(
        "id", F.size("__lines").alias("lines"), F.size("__kept").alias("kept"), F.array_join("__kept", "\n").alias("text"))


def corpora_union(*corpora: DataFrame) -> DataFrame:
    result = corpora[0]
    for corpus in corpora[1:]:
        result = result.unionByName(corpus, allowMissingColumns=True)
    return result


# Correction fields that stand for the whole text.
TEXT_FIELDS = ("ocr_text", "raw_ocr_text", "normalized_ocr_text", "full_text")


def correction_dataset(document: DataFrame, correction: DataFrame, anonymise: bool) -> DataFrame:
    """Training rows of reviewed documents: corrected text, corrected and previous field maps.

    ``document`` has ``id``, ``kind`` and the parts of an image reference; ``correction`` has ``document_id``,
    ``field``, ``before_value``, ``after_value`` and ``ord``. Of several corrections of a field the last counts, of all
    fields that stand for the text the last one; a missing field name means the text. Corrections are reduced to
    one per document and field before a document's fields meet in its maps. On request letters and digits of
    values and of the image reference are masked."""
    hide = (lambda c: mask(c)) if anonymise else (lambda c: c)
    name = F.coalesce(F.nullif("field", F.lit("")), F.lit("full_text"))
    slot = F.when(name.isin(*TEXT_FIELDS), F.lit("full_text")).otherwise(name)
    value = F.struct(F.coalesce("after_value", F.lit("")).alias("after"), F.col("before_value").alias("before"))
    last = correction.groupBy("document_id", slot.alias("slot")).agg(F.max_by(value, F.struct("ord", "after_value", "before_value")).alias("v"))
    is_text = F.col("slot") == "full_text"
    entry = lambda c: F.when(~is_text, F.struct("slot", hide(F.col(f"v.{c}"))))
    maps = last.groupBy("document_id").agg(
        F.max(F.when(is_text, hide(F.col("v.after")))).alias("corrected_text"),
        F.map_from_entries(F.sort_array(F.collect_list(entry("after")))).alias("corrected_fields"),
        F.map_from_entries(F.sort_array(F.collect_list(entry("before")))).alias("previous_fields"))
    none = F.create_map().cast("map<string,string>")
    joined = document.join(maps, document["id"] == maps["document_id"], "left")
    image = [hide(F.col(c)).alias(c) for c in ("safe_name", "sha256", "object_key") if c in document.columns]
    return joined.select(
        "id", F.col("kind").alias("document_type"), *image, "corrected_text", F.coalesce("corrected_fields", none).alias("corrected_fields"),
        F.coalesce("previous_fields", none).alias("previous_fields"), F.lit("train").alias("split"), F.lit(anonymise).alias("anonymised"))


def masked_labels(label: DataFrame) -> DataFrame:
    """Label payloads (JSON) with all string values masked, a row each."""
    return label.withColumn("payload", mask_json(F.col("payload")))
