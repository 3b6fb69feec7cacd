"""Recognition quality: error rates, calibration, comparison and fusion of engines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import groups
from ..functions.text_pairs import edits, word_error_rate
from ..functions.storage import written
from ..functions.text import clamp_round4

# Special letters (the two scoring forms differ) and thresholds.
SPECIAL_LETTERS = "çğıİöşüÇĞIÖŞÜ"
SPECIAL_LETTERS_ALIGNED = "çğıİöşüÇĞÖŞÜ"
BUCKETS = (("0.00-0.50", 0.0, 0.5), ("0.50-0.75", 0.5, 0.75), ("0.75-0.90", 0.75, 0.9), ("0.90-1.00", 0.9, 1.000001))
COVERAGES = (0.25, 0.5, 0.75, 1.0)
AMOUNT = r"(?:₺\s*)?(?:[0-9]{1,3}(?:[.\s,][0-9]{3})+(?:[,.][0-9]{1,2})?|[0-9]+[,.][0-9]{1,3})"
GATE = (
    ("average_cer", ">", 0.35, "CER_TOO_HIGH"), ("snippet_recall", "<", 0.7, "SNIPPET_RECALL_TOO_LOW"),
    ("field_f1", "<", 0.6, "FIELD_F1_TOO_LOW"), ("token_f1", "<", 0.75, "TOKEN_F1_TOO_LOW"),
    ("special_f1", "<", 0.75, "TURKISH_SPECIAL_CHARACTER_F1_TOO_LOW"), ("amount_f1", "<", 0.75, "AMOUNT_F1_TOO_LOW"),
    ("line_item_amount_recall", "<", 0.6, "LINE_ITEM_AMOUNT_RECALL_TOO_LOW"),
    ("line_item_f1", "<", 0.6, "LINE_ITEM_F1_TOO_LOW"),
    ("high_confidence_wrong", ">", 0, "HIGH_CONFIDENCE_WRONG_OUTPUT"),
)


def ratio(part: Column, whole: Column) -> Column:
    """``part / max(whole, 1)``."""
    return part / F.greatest(whole, F.lit(1))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def cer(reference: Column, prediction: Column) -> Column:
    return ratio(edits(reference, prediction), F.length(reference))


def wer(reference: Column, prediction: Column) -> Column:
    """Word error rate: the edit distance of the texts in words, which white space parts."""
    return word_error_rate(reference, prediction)


def error_rates(prediction: DataFrame) -> DataFrame:
    """Row scores every later summary starts from."""
    ok = F.col("error_code").isNull()
    return prediction.where(ok).select(
        "*", cer(F.col("reference"), F.col("prediction")).alias("cer"),
        (F.col("reference") == F.col("prediction")).alias("exact"),
    )


def word_error_rates(prediction: DataFrame) -> DataFrame:
    return prediction.select(
        "sample_id", "engine", F.round(wer(F.col("reference"), F.col("prediction")), 6).alias("wer")
    )


def display_error_rate(prediction: DataFrame) -> DataFrame:
    """Second form: blanks collapsed first, an empty reference scores 0 or 1."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    ref, pred = squeeze(F.col("reference")), squeeze(F.col("prediction"))
    empty = F.when(F.col("prediction") == "", 0.0).otherwise(1.0)
    value = F.when(F.col("reference") == "", empty).otherwise(F.try_divide(F.levenshtein(pred, ref), F.length(ref)))
    return prediction.select("sample_id", "engine", F.round(value, 6).alias("cer"))


def set_prf(left: Column, right: Column) -> Column:
    """Precision, recall and F1 of two arrays taken as sets."""
    hits = F.size(F.array_intersect(left, right))
    p, r = ratio(hits, F.size(F.array_distinct(right))), ratio(hits, F.size(F.array_distinct(left)))
    return F.struct(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def shared_items(left: Column, right: Column) -> Column:
    """Size of the bag intersection of two arrays: both are sorted together, and each item on the right takes
    one equal item before it on the left."""
    side = lambda items, k: F.transform(items, lambda x: F.struct(x.alias("item"), F.lit(k).alias("side")))
    both = F.sort_array(F.concat(side(left, 0), side(right, 1)))

    def step(state: Column, x: Column) -> Column:
        open_ = F.when(state["first"] & (state["item"].eqNullSafe(x["item"])), state["open"]).otherwise(0)
        hit = (x["side"] == 1) & (open_ > 0)
        count = F.when(x["side"] == 0, open_ + 1).when(hit, open_ - 1).otherwise(0)
        return F.struct(F.lit(True).alias("first"), x["item"].alias("item"), count.alias("open"), (state["hits"] + hit.cast("long")).alias("hits"))

    start = F.struct(F.lit(False).alias("first"), F.lit(None).cast("string").alias("item"), F.lit(0).alias("open"), F.lit(0).cast("long").alias("hits"))
    return F.aggregate(both, start, step, lambda state: state["hits"])


def _pooled_overlap(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Bag sizes and intersection of keys whose bags lie in several rows: items become counted rows."""
    side = F.array(F.struct(F.lit(1).alias("l"), F.lit(0).alias("r"), F.col(left).alias("items")),
                   F.struct(F.lit(0).alias("l"), F.lit(1).alias("r"), F.col(right).alias("items")))
    both = rows.select(*keys, F.explode(side).alias("s")).select(*keys, "s.l", "s.r", F.explode("s.items").alias("item"))
    counted = both.groupBy(*keys, "item").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return counted.groupBy(*keys).agg(
        F.sum("l").alias("left_size"), F.sum("r").alias("right_size"), F.sum(F.least("l", "r")).alias("overlap")
    )


def _overlaps(rows: DataFrame, keys: list[str], left: str, right: str, *also: Column) -> tuple[DataFrame, DataFrame]:
    """Bag sizes and intersections per key, and the written sums they come from with the sums ``also``.

    Bags are compared in their row and only numbers travel. Keys of several rows are rare; their items are pooled."""
    full = rows.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (left, right)})
    sized = full.withColumns({"__l": F.size(left).cast("long"), "__r": F.size(right).cast("long"), "__o": shared_items(F.col(left), F.col(right))})
    sums = [F.sum("__l").alias("left_size"), F.sum("__r").alias("right_size"), F.sum("__o").alias("overlap")]
    per_key = written(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *sums, *also), "overlaps")
    filled = per_key.where(F.col("left_size") + F.col("right_size") > 0).select(*keys, "left_size", "right_size", "overlap", "__rows")
    single, several = filled.where("__rows = 1").drop("__rows"), filled.where("__rows > 1").select(*keys)
    if several.isEmpty():
        return single, per_key
    again = groups.join_null_safe(full, several, keys, "inner")
    return single.unionByName(_pooled_overlap(again, keys, left, right)), per_key


def multiset_overlap(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Bag sizes and bag intersection of two arrays of texts per key."""
    return _overlaps(rows, keys, left, right)[0]


def token_prf(prediction: DataFrame) -> DataFrame:
    """Per engine: mean set P/R/F1 over rows and P/R/F1 of the pooled bags."""
    rows = prediction.where(F.col("error_code").isNull()).select(
        "sample_id", "engine", words(F.col("reference")).alias("ref"), words(F.col("prediction")).alias("hyp")
    )
    upper = lambda c: F.array_distinct(F.transform(c, F.upper))
    scored = rows.withColumn("m", set_prf(upper("ref"), upper("hyp")))
    parts = ("precision", "recall", "f1")
    sums = [F.sum(f"m.{c}").alias(f"sum_{c}") for c in parts] + [F.count(f"m.{c}").alias(f"n_{c}") for c in parts]
    overlaps, per_key = _overlaps(scored, ["sample_id", "engine"], "ref", "hyp", *sums)
    macro = per_key.groupBy("engine").agg(
        *[F.round(F.sum(f"sum_{c}") / F.sum(f"n_{c}"), 6).alias(f"macro_{c}") for c in parts]
    )
    pooled = overlaps.groupBy("engine").agg(
        F.sum("overlap").alias("tp"), F.sum("left_size").alias("ref"), F.sum("right_size").alias("hyp")
    )
    p, r = F.col("tp") / F.col("hyp"), F.col("tp") / F.col("ref")
    micro = pooled.select("engine", F.round(p, 6).alias("micro_precision"), F.round(r, 6).alias("micro_recall"),
                          F.round(f1(p, r), 6).alias("micro_f1"))
    return macro.join(micro, "engine")


def amounts(text: Column) -> Column:
    digits = F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), lambda a: F.regexp_replace(a, "[^0-9]", ""))
    return F.array_distinct(F.filter(digits, lambda a: a != ""))


def amount_prf(prediction: DataFrame) -> DataFrame:
    """Amount-token set metrics; rows without any amount do not count."""
    rows = prediction.where(F.col("error_code").isNull()).select(
        "engine", amounts(F.col("reference")).alias("ref"), amounts(F.col("prediction")).alias("hyp")
    ).withColumn("any", F.size("ref") + F.size("hyp") > 0)
    scored = rows.select("engine", F.when(F.col("any"), set_prf(F.col("ref"), F.col("hyp"))).alias("m"))
    return scored.groupBy("engine").agg(
        F.count("m").alias("rows"), *[F.round(F.avg(f"m.{c}"), 6).alias(c) for c in ("precision", "recall", "f1")]
    )


def letter_count(text: Column, letter: str) -> Column:
    """How often a letter occurs: what the text loses without it."""
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def special_letter_prf(prediction: DataFrame, letters: str = SPECIAL_LETTERS) -> DataFrame:
    """Bag metrics of special letters per row, averaged; both empty counts as perfect."""

    tp = sum((F.least(letter_count(F.col("reference"), c), letter_count(F.col("prediction"), c)) for c in letters), F.lit(0))
    ref, hyp = (sum((letter_count(F.col(side), c) for c in letters), F.lit(0)) for side in ("reference", "prediction"))
    p, r = ratio(tp, hyp), ratio(tp, ref)
    both_empty = (ref == 0) & (hyp == 0)
    perfect = lambda c: F.when(both_empty, 1.0).otherwise(c)
    return prediction.where(F.col("error_code").isNull()).groupBy("engine").agg(
        F.round(F.avg(perfect(p)), 6).alias("precision"), F.round(F.avg(perfect(r)), 6).alias("recall"),
        F.round(F.avg(perfect(f1(p, r))), 6).alias("f1"),
    )


def _codes(texts: list[str], width: int) -> np.ndarray:
    codes = np.full((len(texts), width), -1, dtype=np.int32)
    for k, text in enumerate(texts):
        codes[k, : len(text)] = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
    return codes


def _unequal_pairs(references: list[str], predictions: list[str]) -> list[tuple[int, int, int]]:
    """(row, reference code, predicted code) along one cheapest alignment of each
    pair; -1 marks an inserted or deleted character. All pairs of the slice move
    through the cost table together."""
    n = np.array([len(t) for t in references])
    m = np.array([len(t) for t in predictions])
    ref, hyp = _codes(references, int(n.max(initial=1))), _codes(predictions, int(m.max(initial=1)))
    steps = np.arange(hyp.shape[1] + 1)
    table = [np.broadcast_to(steps, (len(n), len(steps)))]
    for i in range(ref.shape[1]):
        best = np.empty_like(table[-1])
        best[:, 0] = i + 1
        swapped = table[-1][:, :-1] + (ref[:, i : i + 1] != hyp)
        best[:, 1:] = np.minimum(swapped, table[-1][:, 1:] + 1)
        # Insertions chain to the right: a running minimum after removing the slope.
        table.append(np.minimum.accumulate(best - steps, axis=1) + steps)
    cost, row, i, j, out = np.stack(table), np.arange(len(n)), n.copy(), m.copy(), []
    while len(row):
        r, h = ref[row, np.maximum(i - 1, 0)], hyp[row, np.maximum(j - 1, 0)]
        here = cost[i, row, j]
        both = (i > 0) & (j > 0) & (here == cost[np.maximum(i - 1, 0), row, np.maximum(j - 1, 0)] + (r != h))
        drop = ~both & (i > 0) & (here == cost[np.maximum(i - 1, 0), row, j] + 1)
        add = ~both & ~drop
        keep = ~both | (r != h)
        out += zip(row[keep], np.where(add, -1, r)[keep], np.where(drop, -1, h)[keep])
        i, j = i - (both | drop), j - (both | add)
        left = (i > 0) | (j > 0)
        row, i, j = row[left], i[left], j[left]
    return out


#: Cells of a cost table that is kept whole; longer pairs are aligned in a band.
WHOLE_CELLS = 4_000_000
#: First guess of a pair's edit distance beyond the difference of the lengths.
FIRST_SPARE = 8


def _band_row(previous: np.ndarray, letter: int, hyp: np.ndarray, first: int) -> np.ndarray:
    """The next row of costs in the band: place b of row i stands for column first + b, one more than in the row before."""
    width, far = len(previous), np.int32(1 << 30)
    columns = np.arange(first, first + width)
    inside = (columns >= 0) & (columns <= len(hyp))
    other = np.ones(width, np.int32)
    real = (columns >= 1) & (columns <= len(hyp))
    other[real] = hyp[columns[real] - 1] != letter
    best = np.where(real, previous + other, far)
    best[:-1] = np.minimum(best[:-1], previous[1:] + 1)
    best[~inside] = far
    steps = np.arange(width, dtype=np.int32)
    row = np.minimum.accumulate(best - steps) + steps
    row[~inside] = far
    return np.minimum(row, far)


def _long_unequal(reference: str, prediction: str) -> list[tuple[int, int]]:
    """Unequal character pairs of two long texts along the alignment that the whole table would give.

    A cheapest alignment of cost c never leaves the diagonals -c to c, so a band that is at least as wide as the
    cost found in it is exact; it is doubled until it is. Every k-th row of the band is kept and the rows between
    are worked out again on the way back, k about the root of the length: memory is band times root, not the product."""
    ref, hyp = (np.frombuffer(t.encode("utf-32-le"), dtype=np.int32) for t in (reference, prediction))
    n, m = len(ref), len(hyp)
    band = max(abs(n - m) + 1, 32)
    every = max(1, int(n**0.5))
    while True:
        columns = np.arange(-band, band + 1)
        row = np.where((columns >= 0) & (columns <= m), columns, 1 << 30).astype(np.int32)
        kept = {0: row}
        for i in range(1, n + 1):
            row = _band_row(row, ref[i - 1], hyp, i - band)
            if i % every == 0:
                kept[i] = row
        cost = int(row[m - n + band])
        if cost <= band or band >= max(n, m):
            break
        band *= 2
    out, i, j, rows, start = [], n, m, [], -1
    while i > 0 or j > 0:
        if start < 0 or i - 1 < start:
            start = max(0, (i - 1) // every * every) if i else 0
            rows = [kept[start]]
            for k in range(start + 1, min(start + every, n) + 1):
                rows.append(_band_row(rows[-1], ref[k - 1], hyp, k - band))
        here = rows[i - start][j - i + band]
        equal = i > 0 and j > 0 and ref[i - 1] == hyp[j - 1]
        above = rows[i - 1 - start] if i > 0 else None
        if i > 0 and j > 0 and here == above[j - i + band] + (not equal):
            if not equal:
                out.append((int(ref[i - 1]), int(hyp[j - 1])))
            i, j = i - 1, j - 1
        elif i > 0 and j - i + 1 + band < len(above) and here == above[j - i + 1 + band] + 1:
            out.append((int(ref[i - 1]), -1))
            i -= 1
        else:
            out.append((-1, int(hyp[j - 1])))
            j -= 1
    return out


def _padded(texts: list[str], first: np.ndarray, width: int, empty: int) -> np.ndarray:
    """Letters of every text as a row of codes from place ``first`` on."""
    lengths = np.array([len(t) for t in texts])
    codes = np.full((len(texts), width), empty, dtype=np.int32)
    places = np.arange(width)
    inside = (places >= first[:, None]) & (places < (first + lengths)[:, None])
    codes[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.int32)
    return codes


def _band(n: np.ndarray, m: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest diagonal and number of diagonals that a cheapest alignment of ``cost`` can touch: to leave the range between
    the first and the last one by k takes 2 k steps more."""
    spare = (cost - np.abs(m - n)) // 2
    return np.minimum(m - n, 0) - spare, np.abs(m - n) + 2 * spare + 1


def _close_pairs(references: list[str], predictions: list[str], cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_unequal_pairs`` gives, as arrays, for pairs whose edit distance is guessed.

    A distance found above the guess bounds the true one: such pairs are done again with it. Only the diagonals that a cheapest alignment can touch are filled; place b of a row stands for diagonal low + b.
    Runs of equal letters are counted along them, and the way back passes a run in one step."""
    n, m = np.array([len(t) for t in references]), np.array([len(t) for t in predictions])
    low, widths = _band(n, m, cost)
    width, rows, far = int(widths.max()), len(n), np.int32(1 << 29)
    ref = _padded(references, np.zeros(rows, int), int(n.max()), -1)
    hyp = _padded(predictions, -low, max(int((m - low).max()), int(n.max()) + width), -2)
    steps, columns = np.arange(width, dtype=np.int32), low[:, None] + np.arange(width)
    table, runs = np.empty((len(ref[0]) + 1, rows, width + 1), np.int32), np.zeros((len(ref[0]) + 1, rows, width), np.int32)
    table[:, :, width] = far
    table[0, :, :width] = np.where(columns >= 0, columns, far)
    for i in range(1, len(table)):
        equal = ref[:, i - 1 : i] == hyp[:, i - 1 : i - 1 + width]
        runs[i] = (runs[i - 1] + 1) * equal
        best = np.minimum(table[i - 1, :, :width] + ~equal, table[i - 1, :, 1:] + 1)
        table[i, :, :width] = np.minimum.accumulate(best - steps, axis=1) + steps
    row, found = np.arange(rows), []
    reached = table[n, row, m - n - low]
    again = np.flatnonzero(reached > cost)
    if len(again):
        k, r, h = _close_pairs([references[x] for x in again], [predictions[x] for x in again], reached[again])
        found.append((again[k], r, h))
    row = np.flatnonzero(reached <= cost)
    i, b = n[row], (m - n - low)[row]
    while len(row):
        run = runs[i, row, b]
        i = i - run
        j = i + b + low[row]
        left = (i > 0) | (j > 0)
        row, i, j, b = row[left], i[left], j[left], b[left]
        here, above = table[i, row, b], np.maximum(i - 1, 0)
        both = (i > 0) & (j > 0) & (here == table[above, row, b] + 1)
        drop = ~both & (i > 0) & (here == table[above, row, b + 1] + 1)
        add = ~both & ~drop
        r, h = ref[row, above], hyp[row, np.maximum(j - 1 - low[row], 0)]
        found.append((row, np.where(add, -1, r), np.where(drop, -1, h)))
        i, b = i - ~add, b + drop - add
    return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (row, row, row)


def char_confusions(prediction: DataFrame) -> DataFrame:
    """Counts of (reference, predicted) character pairs that differ. The traceback
    has no built-in; a guess of the edit distance bounds its table, and each batch is summed before it leaves Python."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, str, str], int] = {}

            def add(engine: str, r: int, h: int, number: int) -> None:
                key = (engine, "<inserted>" if r < 0 else chr(r), "<deleted>" if h < 0 else chr(h))
                counts[key] = counts.get(key, 0) + number

            names, engines = batch["engine"].factorize()[::-1]
            references, predictions = batch["reference"].tolist(), batch["prediction"].tolist()
            n, m = (np.array([len(t) for t in side], dtype=np.int64) for side in (references, predictions))
            # The widest band, for the second round; one that is too large is left to the whole table where that is small.
            cells, whole = (n + 1) * (n + m + 1), (n + 1) * (m + 1) <= WHOLE_CELLS
            for k in np.flatnonzero(cells > WHOLE_CELLS):
                a, b = references[k], predictions[k]
                for r, h in [p[1:] for p in _unequal_pairs([a], [b])] if whole[k] else _long_unequal(a, b):
                    add(names[engines[k]], int(r), int(h), 1)
            guess, order = np.abs(m - n) + FIRST_SPARE, np.argsort(cells, kind="stable")
            order, start = order[cells[order] <= WHOLE_CELLS], 0
            while start < len(order):
                # A table is as large as the longest texts of its slice.
                size = min(512, len(order) - start)
                while size > 1 and size * (n[order[start : start + size]].max() + 1) * ((n + m)[order[start : start + size]].max() + 1) > WHOLE_CELLS:
                    size //= 2
                part = order[start : start + size]
                row, r, h = _close_pairs([references[k] for k in part], [predictions[k] for k in part], guess[part])
                # One number for engine and both letters: 21 bits hold any letter and the -1.
                kinds, numbers = np.unique((engines[part][row].astype(np.int64) << 42) | (r.astype(np.int64) + 1 << 21) | (h.astype(np.int64) + 1), return_counts=True)
                for kind, number in zip(kinds.tolist(), numbers.tolist(), strict=True):
                    add(names[kind >> 42], (kind >> 21 & 0x1FFFFF) - 1, (kind & 0x1FFFFF) - 1, number)
                start += size
            rows = [(*key, c) for key, c in counts.items()]
            yield pd.DataFrame(rows, columns=["engine", "reference_char", "predicted_char", "n"])

    differing = prediction.where(F.col("error_code").isNull() & (F.col("reference") != F.col("prediction")))
    counted = differing.select("engine", "reference", "prediction").mapInPandas(
        pairs, "engine string, reference_char string, predicted_char string, n long"
    )
    return counted.groupBy("engine", "reference_char", "predicted_char").agg(F.sum("n").alias("count"))


def confusion_rank(confusions: DataFrame, n: int = 10) -> DataFrame:
    order = [F.desc("count"), F.asc("predicted_char")]
    return groups.top(confusions, ["engine", "reference_char"], order, n)


def snippet_recall(snippets: Column, prediction: Column) -> Column:
    """Share of the snippets found in the prediction; null without snippets."""
    text = F.upper(F.regexp_replace(prediction, r"\s+", " "))
    found = F.size(F.filter(snippets, lambda s: F.contains(text, F.upper(F.regexp_replace(s, r"\s+", " ")))))
    return F.when(F.size(snippets) > 0, found / F.size(snippets))


def word_recall(expected: Column, prediction: Column) -> Column:
    """Share of the distinct expected words present in the prediction."""
    want, have = F.array_distinct(words(F.upper(expected))), F.array_distinct(words(F.upper(prediction)))
    empty = F.when(F.size(have) == 0, 1.0).otherwise(0.0)
    return F.when(F.size(want) == 0, empty).otherwise(F.try_divide(F.size(F.array_intersect(want, have)), F.size(want)))


def quality_gate(report: DataFrame) -> DataFrame:
    """Pass flag and reasons; a metric the report lacks is not judged, a missing
    error rate fails."""
    rules = [F.when(F.col("succeeded") == 0, "ENGINE_NOT_OK")]
    for column, sign, limit, code in GATE:
        if column in report.columns:
            value = F.col(column)
            bad = value > limit if sign == ">" else value < limit
            if column == "average_cer":
                bad = value.isNull() | bad
            rules.append(F.when(F.coalesce(bad, F.lit(False)), code))
    reasons = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return report.select("engine", (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def _bucket(value: Column) -> Column:
    bucket = None
    for label, low, high in BUCKETS:
        cond = (value >= low) & (value < high)
        bucket = F.when(cond, label) if bucket is None else bucket.when(cond, label)
    return bucket


def calibration(scored: DataFrame) -> DataFrame:
    """Confidence buckets with mean confidence, mean quality and exact rate, and
    each engine's calibration error and Brier score; empty buckets are kept."""
    quality = F.lit(1.0) - F.least(F.col("cer"), F.lit(1.0))
    rows = scored.where(F.col("confidence").isNotNull()).select(
        "engine", "exact", "cer", _bucket(F.col("confidence")).alias("bucket"), "confidence", quality.alias("quality")
    )
    sums = rows.groupBy("engine", "bucket").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("confidence").alias("c"), F.sum("quality").alias("q"),
        F.sum(F.pow(F.col("confidence") - F.col("quality"), 2)).alias("b"), F.count_if("exact").alias("exact"),
        F.sum("cer").alias("cer"),
    )
    per_engine = sums.groupBy("engine").agg(
        F.sum("samples").alias("n"), F.sum("b").alias("b"), F.sum(F.abs(F.col("c") - F.col("q"))).alias("gap")
    ).select("engine", F.round(F.col("gap") / F.col("n"), 6).alias("ece"), F.round(F.col("b") / F.col("n"), 6).alias("brier"))
    labels = F.explode(F.array(*[F.lit(b[0]) for b in BUCKETS])).alias("bucket")
    grid = per_engine.select("*", labels)
    return grid.join(sums, ["engine", "bucket"], "left").select(
        "engine", "bucket", F.coalesce("samples", F.lit(0)).alias("samples"),
        F.round(F.col("c") / F.col("samples"), 6).alias("mean_confidence"),
        F.round(F.col("q") / F.col("samples"), 6).alias("mean_quality"),
        F.round(F.col("exact") / F.col("samples"), 6).alias("exact_rate"),
        F.round(F.col("cer") / F.col("samples"), 6).alias("mean_cer"), "ece", "brier",
    )


def risk_coverage(scored: DataFrame) -> DataFrame:
    """Mean error and lowest confidence of the most confident share of each engine."""
    rows = scored.where(F.col("confidence").isNotNull()).select(
        "engine", "sample_id", "confidence", F.least("cer", F.lit(1.0)).alias("risk")
    )
    ranked = groups.positions(rows, ["engine"], [F.desc("confidence"), F.asc("sample_id")], size="n")
    cuts = [F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(c))) for c in COVERAGES]
    inside = [F.col("position") <= cut for cut in cuts]
    sums = ranked.groupBy("engine").agg(*[F.struct(
        F.lit(c).alias("share"), F.round(F.max(cut) / F.max("n"), 6).alias("coverage"), F.round(F.avg(F.when(own, F.col("risk"))), 6).alias("risk"),
        F.min(F.when(own, F.col("confidence"))).alias("minimum_confidence")).alias(f"c{k}") for k, (c, cut, own) in enumerate(zip(COVERAGES, cuts, inside, strict=True))])
    return sums.select("engine", F.explode(F.array(*[f"c{k}" for k in range(len(COVERAGES))])).alias("cut")).select("engine", "cut.*")


def recognition_slices(scored: DataFrame, by: str = "source") -> DataFrame:
    marks = lambda c: F.regexp_replace(c, "[^0-9.,:;%/+-]", "")
    return scored.groupBy("engine", by).agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("cer"), 6).alias("average_cer"),
        F.round(F.avg(wer(F.col("reference"), F.col("prediction"))), 6).alias("average_wer"),
        F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact_rate"),
        F.round(F.avg((marks("reference") == marks("prediction")).cast("int")), 6).alias("numeric_exact_rate"),
    )


def champion_challenger(pair: DataFrame) -> DataFrame:
    """Wins, regressions and ties of a challenger, overall and per slice, from
    one aggregate over the slice combinations."""
    aspect = (
        F.when(F.col("aspect_ratio") < 3, "lt_3").when(F.col("aspect_ratio") < 6, "3_to_6")
        .when(F.col("aspect_ratio") < 10, "6_to_10").otherwise("ge_10")
    )
    size = F.length("reference")
    length = F.when(size <= 12, "01_12").when(size <= 24, "13_24").when(size <= 48, "25_48").otherwise("49_plus")
    champion, challenger = F.col("champion_cer"), F.col("challenger_cer")
    sums = pair.groupBy(aspect.alias("aspect"), length.alias("length"), "line_role").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("challenger_selected").alias("selected"),
        F.count_if(challenger + 0.02 < champion).alias("wins"),
        F.count_if(champion + 0.02 < challenger).alias("regressions"),
        F.count_if(challenger - champion > 0.10).alias("significant_regressions"),
        F.count_if(F.col("challenger_selected") & (challenger - champion > 0.02)).alias("composed_regressions"),
    )
    slices = F.array(
        *[F.struct(F.lit(k).alias("slice"), v.alias("value")) for k, v in (
            ("all", F.lit("all")), ("aspect", F.col("aspect")), ("length", F.col("length")), ("role", F.col("line_role")))]
    )
    counts = ("samples", "selected", "wins", "regressions", "significant_regressions", "composed_regressions")
    out = sums.select(F.explode(slices).alias("s"), *counts).groupBy("s.slice", "s.value").agg(
        *[F.sum(c).alias(c) for c in counts]
    )
    return out.withColumn("ties", F.col("samples") - F.col("wins") - F.col("regressions")).withColumn(
        "regression_rate", F.round(F.col("regressions") / F.col("samples"), 6)
    )


def checkpoint_ranking(report: DataFrame, by_source: DataFrame) -> DataFrame:
    """Weighted selection score of each model, best first."""
    worst = by_source.groupBy("engine").agg(F.max("average_cer").alias("worst_cer"))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    error = lambda c: F.lit(1.0) - unit(F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(1.0)))
    # Weights.
    score = (
        error("average_cer") * 0.35 + unit(F.col("token_f1")) * 0.20 + unit(F.col("special_f1")) * 0.15
        + unit(F.col("amount_f1")) * 0.15 + unit(F.col("exact_rate")) * 0.05 + error("worst_cer") * 0.10
    )
    return report.join(worst, "engine", "left").select("engine", F.round(score, 6).alias("selection_score"))


def classification_report(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per-class precision, recall, F1 and support with accuracy and macro F1.

    ``pairs`` is summed to a confusion table first; labels seen only as a
    prediction keep a row with zero support."""
    table = pairs.groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    side = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed")),
    )
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    labels = table.select(*keys, hit.alias("hit"), F.explode(side).alias("s")).groupBy(*keys, "s.label").agg(
        F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"),
        F.sum(F.when(F.col("s.support") > 0, F.col("hit")).otherwise(0)).alias("hit"),
    )
    p, r = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    scored = labels.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    totals = scored.groupBy(*keys).agg(
        F.round(F.sum("hit") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1")
    )
    rounded = {c: F.round(c, 6) for c in ("precision", "recall", "f1")}
    rows = scored.withColumns(rounded).drop("hit", "guessed")
    if not keys:
        return rows.withColumn("__one", F.lit(1)).join(totals.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return groups.join_null_safe(rows, totals, keys, "inner")


def confusion_rows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("count"))


def class_metrics(scored: DataFrame, subset: tuple[str, ...] = tuple(SPECIAL_LETTERS)) -> DataFrame:
    """Top-1 and top-3 accuracy and macro F1 per run, and the accuracy on the classes of ``subset`` alone.

    ``candidates`` is ranked. A run without a row of the subset has no accuracy there."""
    own = F.col("actual").isin(*subset)
    top = scored.groupBy("run").agg(
        F.count_if(own).alias("subset_support"), F.round(F.avg(F.when(own, (F.col("actual") == F.col("predicted")).cast("int"))), 6).alias("subset_top1"),
        F.round(F.avg((F.col("actual") == F.col("predicted")).cast("int")), 6).alias("top1"),
        F.round(F.avg(F.array_contains(F.slice("candidates", 1, 3), F.col("actual")).cast("int")), 6).alias("top3"),
    )
    macro = classification_report(scored, ["run"]).groupBy("run").agg(F.max("macro_f1").alias("macro_f1"))
    return top.join(macro, "run")


def seed_regression(report: DataFrame, minimum: float = 0.65) -> DataFrame:
    """Mean and worst accuracy and macro F1 over runs, with the pass flag."""
    runs = report.groupBy("run").agg(F.max("accuracy").alias("accuracy"), F.max("macro_f1").alias("macro_f1"))
    passed = (F.min("accuracy") >= minimum) & (F.min("macro_f1") >= minimum)
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"),
        F.min("accuracy").alias("min_accuracy"), F.round(F.avg("macro_f1"), 6).alias("mean_macro_f1"),
        F.min("macro_f1").alias("min_macro_f1"), passed.alias("passed"),
    )


# --- several engines on one document ---------------------------------------------------


def engine_selection(extracted: DataFrame) -> DataFrame:
    """Best engine run of each document by confidence, readiness and issues."""
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    penalty = F.least(F.lit(0.72), count("critical") * 0.22 + count("warning") * 0.04)
    score = clamp_round4(F.round(unit(F.col("confidence")) * 0.36 + F.col("readiness") * 0.64 - penalty, 9))
    missing = F.filter(
        F.array(F.when(F.col("total_minor").isNull(), "total"), F.when(F.col("date").isNull(), "date"),
                F.when(F.col("merchant").isNull(), "merchantName")), lambda m: m.isNotNull())
    reason = F.when(F.size(missing) == 0, "selected-by-extraction-readiness-and-ocr-confidence").otherwise(
        F.concat(F.lit("selected-with-review-needed-missing:"), F.array_join(missing, ",")))
    rows = extracted.select("doc_id", "engine", "run_order", score.alias("score"), reason.alias("reason"), "confidence")
    best = F.max_by(F.struct("engine", "score", "reason"), F.struct("score", -F.col("run_order"))).alias("b")
    return rows.groupBy("doc_id").agg(
        best, F.round(F.avg(unit(F.col("confidence"))), 4).alias("average_confidence"), F.count(F.lit(1)).alias("runs")
    ).select("doc_id", F.col("b.engine").alias("selected_engine"), "b.score", "b.reason", "average_confidence", "runs")


FUSED = ("merchant", "date", "currency", "subtotal_minor", "tax_minor", "discount_minor", "total_minor", "payment_method")


def field_fusion(extracted: DataFrame) -> DataFrame:
    """One value per document and field from all engines, with its agreement status."""
    codes = F.transform("issues", lambda i: i["code"])
    has = lambda *names: F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))
    # Validation penalties.
    cost = (
        F.when((F.col("field") == "total_minor") & F.col("m_total"), 0.4)
        .when((F.col("field") == "date") & F.col("m_date"), 0.25)
        .when((F.col("field") == "merchant") & F.col("m_merchant"), 0.2)
        .when(F.col("field").isin("subtotal_minor", "tax_minor", "discount_minor") & F.col("m_sum"), 0.2).otherwise(0.0)
    )
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias("value")) for f in FUSED
    ])
    long = extracted.select(
        "doc_id", "engine", "run_order", has("MISSING_TOTAL").alias("m_total"),
        has("MISSING_DATE", "FUTURE_DATE").alias("m_date"), has("MISSING_MERCHANT").alias("m_merchant"),
        has("SUBTOTAL_TAX_TOTAL_MISMATCH").alias("m_sum"),
        clamp_round4((F.col("field_confidence") + F.col("confidence")) / 2).alias("confidence"), F.explode(fields).alias("f"),
    ).select("*", "f.field", "f.value").drop("f")
    weighed = long.withColumn("net", F.col("confidence") - cost)
    lowered = F.lower(F.translate("value", "Iİ", "ıi"))
    candidates = weighed.groupBy("doc_id", "field", lowered.alias("key")).agg(
        F.count("value").alias("n"), F.sum("net").alias("net"),
        F.min_by("value", "run_order").alias("value"), F.min("run_order").alias("first"),
        F.max_by("engine", F.struct("net", -F.col("run_order"))).alias("engine"),
    )
    mean = F.col("net") / F.col("n") + F.when(F.col("n") > 1, 0.1).otherwise(0.0)
    score = F.when(F.col("key").isNotNull(), clamp_round4(F.round(mean, 9)))
    best = F.max_by(F.struct("value", "engine", "score", "n"), F.when(F.col("key").isNotNull(), F.struct("score", -F.col("first"))))
    fused = candidates.withColumn("score", F.when(F.col("n") > 0, score)).groupBy("doc_id", "field").agg(
        best.alias("b"), F.count("key").alias("groups")
    )
    status = (
        F.when(F.col("groups") == 0, "missing").when(F.col("groups") > 1, "conflict")
        .when(F.col("b.n") > 1, "exact_match").otherwise("single_source")
    )
    return fused.select(
        "doc_id", "field", "b.value", F.coalesce("b.engine", F.lit("NONE")).alias("source_engine"),
        F.coalesce("b.score", F.lit(0.0)).alias("confidence"), status.alias("status"),
    )


def pairwise_similarity(run: DataFrame) -> DataFrame:
    """Mean text similarity over all pairs of runs of a document, whatever their engines.

    The runs of a document are few; they are one array and the pairs stay inside its row."""
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    runs = run.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_list(squeezed)).alias("runs"))

    def similarity(a: Column, b: Column) -> Column:
        longest = F.greatest(F.length(a), F.length(b))
        return F.when(longest == 0, 1.0).otherwise(clamp_round4(F.lit(1.0) - F.try_divide(F.levenshtein(a, b), longest)))

    later = lambda i: F.slice("runs", i + 2, 1 << 30)
    scores = F.flatten(F.transform("runs", lambda a, i: F.transform(later(i), lambda b: similarity(a, b))))
    mean = F.when(F.size("s") > 0, F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"))
    return runs.select("doc_id", scores.alias("s")).select("doc_id", F.round(mean, 6).alias("similarity"))


# Words that mark a plausible receipt.
ATTEMPT_WORDS = ("toplam", "fatura", "fis", "kdv", "tarih", "try", "tl", "ode", "urun", "tutar")


def attempt_selection(attempt: DataFrame) -> DataFrame:
    """Best recognition attempt of each page and whether it is good enough."""
    low = F.lower("text")
    hits = sum((F.when(F.contains(low, F.lit(w)), 0.04).otherwise(0.0) for w in ATTEMPT_WORDS), F.lit(0.0))
    size = F.length(F.trim("text"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")) * 0.7
                    + F.least(size / 500.0, F.lit(1.0)) * 0.2 + F.least(hits, F.lit(0.2)))
    rows = attempt.select("doc_id", "page", "attempt_id", F.round(score, 6).alias("score"), size.alias("size"))
    best = F.max_by(F.struct("attempt_id", "score", "size"), F.struct("score", -F.col("attempt_id"))).alias("b")
    good = (F.col("b.score") >= 0.58) & (F.col("b.size") >= 12)
    return rows.groupBy("doc_id", "page").agg(best, F.count(F.lit(1)).alias("attempts")).select(
        "doc_id", "page", "b.attempt_id", "b.score", good.alias("good"), "attempts"
    )


def extraction_gate(run: DataFrame) -> DataFrame:
    """Why a selected custom run may not continue to field extraction; null = go on."""
    warned = lambda c: F.array_contains("warnings", c)
    code = F.when(F.col("engine") != "CUSTOM_CRNN", F.lit(None).cast("string"))
    for name in ("CUSTOM_OCR_LOW_REAL_DOCUMENT_CONFIDENCE", "CUSTOM_OCR_LOW_CONFIDENCE", "CUSTOM_OCR_SEGMENTATION_SUSPECT"):
        code = code.when(warned(name), name)
    code = code.when(F.col("critical_issues").isNull(), "CUSTOM_OCR_REVIEW_REQUIRED").when(
        F.col("critical_issues") > 0, "CUSTOM_OCR_REQUIRES_REVIEW")
    return run.select("doc_id", code.alias("skip_reason"))


def calibrated_confidence(run: DataFrame, model: DataFrame) -> DataFrame:
    """Confidence × reliability of the model × quality of the page."""
    reliability = F.bround(F.greatest(F.lit(0.25), F.lit(1.0) - F.least(F.col("validation_cer"), F.lit(0.75))), 4)
    page = (
        F.when(F.col("page_status") != "ok", 0.85).otherwise(1.0)
        * F.when(F.abs("skew") >= 2.0, 0.8).otherwise(1.0)
        * F.when((F.col("density") < 0.005) | (F.col("density") > 0.45), 0.85).otherwise(1.0)
    )
    joined = run.join(model.select("model_id", "validation_cer"), "model_id", "left")
    known = F.when(F.col("validation_cer").isNotNull(), reliability).otherwise(1.0)
    joined = joined.withColumn("reliability", known).withColumn("page_factor", F.bround(page, 4))
    return joined.withColumn("calibrated", F.bround(F.col("confidence") * F.col("reliability") * F.col("page_factor"), 4))


def route_evidence_gate(report: DataFrame) -> DataFrame:
    """Slices of a champion/challenger report good enough to route on."""
    ok = (
        (F.col("samples") >= 30) & (F.col("champion_cer") - F.col("challenger_cer") >= 0.05)
        & (F.col("regression_rate") <= 0.05) & (F.col("significant_regressions") == 0)
        & (F.length("digest") == 64)
    )
    return report.withColumn("accepted", F.coalesce(ok, F.lit(False)))
