"""Calendars: seasons, business days, stages, releases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_year(at: Column, start_month: int) -> Column:
    """The year in which the season of ``at`` began."""
    return F.year(at) - (F.month(at) < start_month).cast("int")


def season_label(at: Column, start_month: int) -> Column:
    """As 2011-12."""
    first = crop_year(at, start_month)
    return F.concat(first.cast("string"), F.lit("-"), F.lpad(F.pmod(first + 1, F.lit(100)).cast("string"), 2, "0"))


def normalized_season(raw: Column) -> Column:
    """2011/2012, 2011-2012 and 2011/12 as 2011-12; null if it is no season."""
    first, second = F.regexp_extract(raw, r"^\s*(\d{4})\s*[/-]\s*(\d{2,4})\s*$", 1), F.regexp_extract(raw, r"^\s*(\d{4})\s*[/-]\s*(\d{2,4})\s*$", 2)
    return F.when(first != "", F.concat(first, F.lit("-"), F.right(second, F.lit(2))))


def month_in_window(month: Column, first: int, last: int) -> Column:
    """Whether a month lies in a window that may pass the end of the year."""
    return month.between(first, last) if first <= last else (month >= first) | (month <= last)


def stage_end(season: Column, start_month: int, last_month: int) -> Column:
    """The last day of a stage that ends with ``last_month`` of the season."""
    return F.last_day(F.make_date(season + (0 if last_month >= start_month else 1), F.lit(last_month), F.lit(1)))


def previous_business_day(day: Column) -> Column:
    """The last weekday before ``day``."""
    back = F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1)
    return F.date_sub(day, back)


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays after ``start`` up to ``end``; 0 if end isn't after start."""
    # weekdays from a Monday long past up to a day, both of them counted
    upto = lambda d: F.floor(F.datediff(d, F.lit("1900-01-01").cast("date")) / 7) * 5 + F.least(F.weekday(d) + 1, F.lit(5))
    return F.greatest((upto(end) - upto(start)).cast("int"), F.lit(0))


def next_release(after: Column, rule: str, number: int) -> Column:
    """The first release after a day: ``day`` (of each month), ``month_end`` plus days, ``weekday`` (1 Monday), ``business_day`` (n-th of each month), ``quarter_end`` plus days."""
    if rule == "day":
        here = F.make_date(F.year(after), F.month(after), F.lit(number))
        return F.when(here > after, here).otherwise(F.add_months(here, 1))
    if rule == "month_end":
        here = F.date_add(F.last_day(F.add_months(after, -1)), number)
        return F.when(here > after, here).otherwise(F.date_add(F.last_day(after), number))
    if rule == "weekday":
        return F.next_day(after, ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"][number - 1])
    if rule == "quarter_end":
        end = F.date_sub(F.trunc(after, "quarter"), 1)
        here = F.date_add(end, number)
        return F.when(here > after, here).otherwise(F.date_add(F.last_day(F.add_months(F.trunc(after, "quarter"), 2)), number))
    if rule == "business_day":
        nth = lambda first: F.element_at(F.filter(F.sequence(first, F.date_add(first, 27)), lambda d: F.weekday(d) < 5), number)
        here = nth(F.trunc(after, "month"))
        return F.when(here > after, here).otherwise(nth(F.trunc(F.add_months(after, 1), "month")))
    raise ValueError(rule)


def contract_year(digits: Column, traded: Column, modulus: int = 10) -> Column:
    """The year of a delivery month given by its last digit (modulus 10) or two (100): the first one not before the year of trading."""
    year = F.year(traded)
    return year + F.pmod(digits - year, F.lit(modulus))
