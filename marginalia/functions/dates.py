"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.functions.planning import let
from marginalia.settings import LOOKBACK_DAYS, MIN_PLAUSIBLE_YEAR, RESULT_TTL_DAYS


def iso_date(text: Column) -> Column:
    """Date from the first ten characters of an ISO text; null when it is none.

    Accepts calendar dates (dashed or compact) and ISO week dates.
    """
    return let(F.substring(text.cast("string"), 1, 10), _iso_date)


def _iso_date(head: Column) -> Column:
    calendar = F.when(F.rlike(head, F.lit(r"^\d{4}-\d\d-\d\d$")), F.try_to_date(head, "yyyy-MM-dd")).when(
        F.rlike(head, F.lit(r"^\d{8}$")), F.try_to_date(head, "yyyyMMdd")
    )
    return F.when(F.contains(head, F.lit("W")), _week_date(head)).otherwise(calendar)


def _week_date(head: Column) -> Column:
    week = r"^(\d{4})(-?)W(\d\d)(?:\2([1-7]))?$"
    year = F.regexp_extract(head, week, 1).try_cast("int")
    number = F.regexp_extract(head, week, 3).try_cast("int")
    day = F.coalesce(F.regexp_extract(head, week, 4).try_cast("int"), F.lit(1))
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(jan4, F.weekday(jan4))
    # The week of 28 December is the last one of its ISO year.
    last = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    return F.when(number.between(1, last), F.date_add(monday, (number - 1) * 7 + day - 1))


def sane_date(text: Column, as_of: Column) -> Column:
    """``iso_date`` limited to plausible years: 2005 up to the year after ``as_of``."""
    # No lambda here: `as_of` may be a subquery, which lambdas do not allow.
    day = iso_date(text)
    return F.when(F.year(day).between(MIN_PLAUSIBLE_YEAR, F.year(as_of) + 1), day)


def from_epoch_ms(ms: Column) -> Column:
    """Timestamp of epoch milliseconds; a missing value counts as 0."""
    return F.timestamp_millis(F.coalesce(ms, F.lit(0).cast("bigint")))


def lookback_start(as_of: Column, days: int = LOOKBACK_DAYS) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def expiry(submitted_at: Column, days: int = RESULT_TTL_DAYS) -> Column:
    return submitted_at + F.make_dt_interval(F.lit(days))
