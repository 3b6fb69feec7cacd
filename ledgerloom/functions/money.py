"""Money expressions: integer minor units, truncating arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

EXACT = "decimal(38,0)"

# The supported currencies (all with two minor digits).
CURRENCIES = ("TRY", "USD", "EUR", "GBP")


def exact(col: Column | str) -> Column:
    """Widen minor units so that sums cannot overflow a long."""
    return (F.col(col) if isinstance(col, str) else col).cast(EXACT)


def zero() -> Column:
    return F.lit(0).cast(EXACT)


def total(col: Column | str) -> Column:
    return F.sum(exact(col))


def total_where(cond: Column, col: Column | str) -> Column:
    """Sum of the rows that satisfy ``cond``; 0 when none does."""
    return F.coalesce(F.sum(F.when(cond, exact(col))), F.lit(0).cast(EXACT))


def trunc_div(part: Column, whole: Column) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", part, whole)


def percent_2dp(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent, truncated to two decimals, 0 for an empty whole."""
    scaled = trunc_div(exact(part) * F.lit(10000), F.nullif(exact(whole), F.lit(0).cast(EXACT)))
    return F.coalesce(scaled.cast("double") / F.lit(100.0), F.lit(0.0))


def _digits_to_minor(sign: Column, major: Column, minor: Column) -> Column:
    value = F.concat(major, F.rpad(minor, 2, "0")).try_cast(EXACT)
    return F.when(sign == "-", -value).otherwise(value)


def parse_import_amount(text: Column, is_minor: Column) -> Column:
    """Minor-unit integer, or ``major[.,]d{1,2}``; null when malformed."""
    value = F.trim(text)
    pattern = r"^(-?)([0-9]+)(?:[,.]([0-9]{1,2}))?$"
    whole = F.when(value.rlike(r"^-?[0-9]+$"), value.try_cast(EXACT))
    split = F.when(
        value.rlike(pattern),
        _digits_to_minor(
            F.regexp_extract(value, pattern, 1),
            F.regexp_extract(value, pattern, 2),
            F.regexp_extract(value, pattern, 3),
        ),
    )
    return F.when(is_minor, whole).otherwise(split)


def parse_locale_amount(text: Column) -> Column:
    """Amount in either locale to minor units: the last ``,`` or ``.`` is the
    decimal mark and needs one or two digits after it; null when malformed."""

    def plain(kept: Column) -> Column:
        return (
            F.when(kept.rlike(r",[^.]*$"), F.translate(F.translate(kept, ".", ""), ",", "."))
            .when(F.contains(kept, F.lit(".")), F.translate(kept, ",", ""))
            .otherwise(kept)
        )

    def minor(value: Column) -> Column:
        pattern = r"^(-?)([0-9]+)(?:\.([0-9]{1,2}))?$"
        return F.when(
            value.rlike(pattern),
            _digits_to_minor(*(F.regexp_extract(value, pattern, g) for g in (1, 2, 3))),
        )

    return let(F.regexp_replace(text, r"[^0-9,.\-]", ""), lambda kept: let(plain(kept), minor))
