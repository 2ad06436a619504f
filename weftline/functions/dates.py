"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column

year, month, day, day_of_week, day_of_year = F.year, F.month, F.dayofmonth, F.dayofweek, F.dayofyear
week_of_year, weekday, quarter, last_day = F.weekofyear, F.weekday, F.quarter, F.last_day
add_days, sub_days, add_months, date_diff = F.date_add, F.date_sub, F.add_months, F.datediff
make_date, to_date, current_date = F.make_date, F.to_date, F.current_date


def next_day(c, day_name: str) -> Column:
    return F.next_day(column(c), day_name)


def months_between(end, start) -> Column:
    return F.months_between(column(end), column(start))


def date_trunc(unit: str, c) -> Column:
    """The first date of the unit, as a date."""
    return F.trunc(column(c), unit)


def date_format(c, form: str) -> Column:
    return F.date_format(column(c), form)
