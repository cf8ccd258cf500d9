"""Date expressions. ``as_of`` is always passed in; nothing reads the clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: date | str | Column) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(str(value)).cast("date")


def days_before(as_of: date | str | Column, n: int) -> Column:
    return F.date_sub(day(as_of), n)


def parse_day(text: Column) -> Column:
    """'YYYY-MM-DD' -> DATE, NULL when it is none."""
    return F.try_to_timestamp(text, F.lit("y-M-d")).cast("date")


def parse_moment(text: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS' -> TIMESTAMP_NTZ, NULL when it is none."""
    return F.try_to_timestamp(text, F.lit("y-M-d H:m:s")).cast("timestamp_ntz")


def iso_day(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def iso_moment(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def short_day(value: Column) -> Column:
    return F.date_format(value, "MM-dd")


def day_offset(value: Column, as_of: date | str | Column) -> Column:
    """Position in a series ending at ``as_of``: -1 is ``as_of`` itself."""
    return F.datediff(value.cast("date"), day(as_of)) - 1
