"""Calendar dates and decimal years as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _days(year: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(leap, 366).otherwise(365)


def numeric_date(d: Column) -> Column:
    """Decimal year of a date: year + (day of the year - 0.5) / days of the year."""
    y = F.year(d)
    return y + (F.dayofyear(d) - F.lit(0.5)) / _days(y)


def date_of(numeric: Column) -> Column:
    """Date of a decimal year: day int((fraction + 1e-10) * days of the year)."""
    y = F.floor(numeric).cast("int")
    day = F.floor((numeric - y + F.lit(1e-10)) * _days(y)).cast("int")
    return F.date_add(F.make_date(y, F.lit(1), F.lit(1)), day)


def date_bounds(text: Column) -> tuple[Column, Column]:
    """(lo, hi) decimal years of a written date; null where it is none.

    Decimal year, [lo:hi], YYYY-MM-DD, YYYY-MM-XX, YYYY-XX-XX. The last day of February is the 28th.
    """
    t = F.trim(text)
    number = F.when(t.rlike(r"^[0-9]{4}(\.[0-9]+)?$"), t.try_cast("double"))
    pair = r"^\[\s*([0-9]{4}(?:\.[0-9]+)?)\s*:\s*([0-9]{4}(?:\.[0-9]+)?)\s*\]$"
    part = lambda k: F.when(t.rlike(pair), F.regexp_extract(t, pair, k).try_cast("double"))
    day = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date"))
    y = F.substring(t, 1, 4)
    month = t.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-XX$")
    year = t.rlike(r"^[0-9]{4}-XX-XX$")
    m = F.substring(t, 6, 2)
    last = F.when(m == "02", "28").when(m.isin("04", "06", "09", "11"), "30").otherwise("31")
    first_day = F.when(month, F.concat(y, F.lit("-"), m, F.lit("-01"))).when(year, F.concat(y, F.lit("-01-01"))).try_cast("date")
    last_day = F.when(month, F.concat(y, F.lit("-"), m, F.lit("-"), last)).when(year, F.concat(y, F.lit("-12-31"))).try_cast("date")
    return (
        F.coalesce(number, part(1), numeric_date(day), numeric_date(first_day)),
        F.coalesce(number, part(2), numeric_date(day), numeric_date(last_day)),
    )


def date_of_distance(distance: Column, slope: Column, intercept: Column) -> Column:
    """Decimal year at which a clock expects a root-to-tip distance."""
    return (distance - intercept) / slope
