"""Calendar expressions, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_of(ts: Column | str) -> Column:
    """First day of the month, as a date."""
    return F.trunc(ts, "month")


def in_month(ts: Column, first_day: str) -> Column:
    """Half-open month range on the raw column, so that it reaches the scan."""
    start = F.lit(first_day).cast("date")
    return (ts >= start) & (ts < F.add_months(start, 1))


def is_weekend(ts: Column | str) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes, floored, so that a half-second overrun counts as -1."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(60_000_000.0)).cast("long")


def add_month_overflowing(ts: Column) -> Column:
    """One calendar month later; days past the end roll into the month after."""
    first = F.add_months(F.trunc(ts, "month"), 1)
    days = F.datediff(F.date_add(first, F.dayofmonth(ts) - 1), ts.cast("date"))
    return ts + F.make_dt_interval(days)


def _valid_date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return text.try_cast("date")


def parse_mixed_date(text: Column, swap: bool = True) -> Column:
    """ISO, yyyymmdd, ddmmyyyy and d.m.y(y) dates; null when impossible.

    With ``swap`` a "month" above 12 is taken for the day."""
    value = F.trim(text)
    iso = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
    ymd = r"^((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})$"
    dmy8 = r"^([0-9]{2})([0-9]{2})([0-9]{4})$"
    dmy = r"^([0-9]{1,2})[./\-]([0-9]{1,2})[./\-]([0-9]{4}|[0-9]{2})$"

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))

    first, second = part(dmy, 1), part(dmy, 2)
    year = F.when(F.length(part(dmy, 3)) == 2, F.concat(F.lit("20"), part(dmy, 3))).otherwise(part(dmy, 3))
    if swap:
        swapped = second.try_cast("int") > 12
        day, month = F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second)
    else:
        day, month = first, second
    return F.coalesce(
        _valid_date(part(iso, 1), part(iso, 2), part(iso, 3)),
        _valid_date(part(ymd, 1), part(ymd, 2), part(ymd, 3)),
        _valid_date(part(dmy8, 3), part(dmy8, 2), part(dmy8, 1)),
        _valid_date(year, month, day),
    )


def normalise_time(text: Column) -> Column:
    """``h:mm[:ss]`` to ``HH:mm``; null outside the clock."""
    pattern = r"([0-9]{1,2})[:.]([0-9]{2})(?:[:.][0-9]{2})?"
    hour = F.regexp_extract(text, pattern, 1).try_cast("int")
    minute = F.regexp_extract(text, pattern, 2).try_cast("int")
    ok = hour.between(0, 23) & minute.between(0, 59)
    return F.when(ok, F.format_string("%02d:%02d", hour, minute))
