"""Text expressions: folding, masking, slugs, flags."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, functions as F


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and the ASCII letter each decomposes to."""
    source, target = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and base.isalpha():
            source.append(chr(code))
            target.append(base)
    # Dotless i has no decomposition but folds to a plain i.
    return "".join(source) + "ı", "".join(target) + "i"


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), "[̀-ͯ]", "")


def fold(text: Column) -> Column:
    """Lower case, no accents, anything but ASCII letters and digits a space."""
    # A plain ASCII text has no accent to strip, and single blanks need no replacement.
    plain = F.when(text.rlike("[^\\x00-\\x7F]"), strip_accents(text)).otherwise(text)
    spaced = F.regexp_replace(F.lower(plain), "[^a-z0-9](?<! (?=[a-z0-9]))[^a-z0-9]*", " ")
    return F.trim(spaced)


def fold_lines(text: Column) -> Column:
    """``fold`` of every line, as an array."""
    plain = F.when(text.rlike("[^\\x00-\\x7F]"), strip_accents(text)).otherwise(text)
    # The line break takes the place of the character after z: a class of two ranges is searched much faster than one of more.
    marked = F.replace(F.replace(F.lower(plain), F.lit("{"), F.lit(" ")), F.lit("\n"), F.lit("{"))
    spaced = F.regexp_replace(marked, "[^a-{0-9](?<! (?=[a-{0-9]))[^a-{0-9]*", " ")
    return F.transform(F.split(spaced, r"\{"), lambda x: F.trim(x))


def phrases(pattern: str) -> tuple[str, ...]:
    """All texts that a pattern of words in folded text stands for: literal words, blanks and alternatives."""
    plain = pattern.replace(r"\b", "").replace(r"\s+", " ").replace(r"\s*", "(?:| )")
    found, group = [plain], re.compile(r"\(\?:([^()]*)\)")
    while any(group.search(x) for x in found):
        found = [group.sub(lambda _: part, x, count=1) for x in found for part in group.search(x)[1].split("|")]
    if not all(re.fullmatch("[a-z0-9 ]+", x) for x in found):
        raise ValueError(f"not a pattern of plain words: {pattern}")
    return tuple(dict.fromkeys(found))


def says(spaced: Column, pattern: str) -> Column:
    """Whether folded text with a blank at both ends has one of the pattern's phrases as whole words."""
    # The phrase alone is searched first: a blank begins at every word, so that a search from it stops at each.
    found = (F.contains(spaced, F.lit(x)) & F.contains(spaced, F.lit(f" {x} ")) for x in phrases(pattern))
    return reduce(lambda a, b: a | b, found)


def normalise_name(text: Column) -> Column:
    """Trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def parse_flag(text: Column) -> Column:
    """Yes/no words to a boolean, blank is false, anything else null."""
    word = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    # Accepted words.
    return (
        F.when(word.isin("true", "1", "yes", "y", "evet"), F.lit(True))
        .when(word.isin("", "false", "0", "no", "n", "hayir"), F.lit(False))
    )


def safe_name(name: Column) -> Column:
    """File-name slug without path parts; ``upload`` when nothing is left."""
    kept = F.regexp_replace(strip_accents(name), r"[^A-Za-z0-9_.\- ]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, " +", "-"), r"\.+", ".")
    slug = F.lower(F.regexp_replace(dashed, r"^[.\-]+|[.\-]+$", ""))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("upload"))


def csv_cell(col: Column, kind: str) -> Column:
    """One exported cell as text; formula starters get a quote prefix."""
    if kind.startswith("timestamp"):
        text = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    else:
        text = col.cast("string")
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def mask(text: Column) -> Column:
    """Letters to X, digits to 0; layout and punctuation stay."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{Nd}", "0"), r"\p{L}", "X")


def mask_json(payload: Column) -> Column:
    """JSON text with every string value masked, at any depth; keys, numbers and layout stay.

    The text is cut into strings and the rest. A string that no colon follows is a value: it is decoded, masked and
    written again, so escapes stay whole."""
    tokens = F.regexp_extract_all(payload, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?|[^"]+'), F.lit(0))
    words = lambda t: F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")
    written = lambda t: F.regexp_replace(F.to_json(F.transform(words(t), mask)), r"^\[|\]$", "")
    masked = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit('"')) & ~t.rlike(r":\z"), written(t)).otherwise(t))
    return F.array_join(masked, "")


def reason_codes(codes: Column) -> Column:
    """Upper-case slugs, distinct in first-seen order, at most twelve."""
    slugs = F.transform(codes, lambda c: F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9_]", "_"))
    return F.slice(F.array_distinct(F.filter(slugs, lambda c: c != "")), 1, 12)


def repair_mojibake(text: Column, markers: str = "ÂÃÄÅ") -> Column:
    """Undo UTF-8 bytes read as Latin-1, where the text shows the markers."""
    suspicious = text.rlike(f"[{markers}]") & ~text.rlike("[^\u0000-ÿ]")
    raw = F.when(suspicious, F.encode(text, "ISO-8859-1"))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), text)


# Letters that speak for a text and marks that speak against it.
TEXT_LETTERS, TEXT_MARKS = "çğıİöşüÇĞÖŞÜ", "ÃÄÅÂ"


def repair_mojibake_scored(text: Column) -> Column:
    """The re-decoded text where it scores better than the text itself: letters gained, marks lost."""
    score = lambda c: F.regexp_count(c, F.lit(f"[{TEXT_LETTERS}]")) - F.regexp_count(c, F.lit(f"[{TEXT_MARKS}]"))
    raw = F.when(~text.rlike("[^\u0000-ÿ]"), F.encode(text, "ISO-8859-1"))
    repaired = F.try_validate_utf8(raw.cast("string"))
    return F.when(score(repaired) > score(text), repaired).otherwise(text)


def clamp_round4(value: Column) -> Column:
    """Clamp to 0..1 and round half up to four decimals."""
    # least and greatest skip nulls, so a missing value is kept apart.
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(value.isNotNull(), F.floor(bounded * 10000 + F.lit(0.5)) / F.lit(10000.0))


def fixed4(value: Column) -> Column:
    """Four-decimal text of an optional number, blank when missing."""
    return F.when(value.isNotNull(), F.format_string("%.4f", value)).otherwise(F.lit(""))
