"""Zero-filled series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import day, days_before


def day_grid(dim: DataFrame, as_of: date | str, days: int, name: str = "day") -> DataFrame:
    """Every row of ``dim`` once per day of the ``days`` ending at ``as_of``."""
    return dim.select("*", F.explode(F.sequence(days_before(as_of, days - 1), day(as_of))).alias(name))


def fill_days(
    dim: DataFrame, key: str, facts: DataFrame, value: str, as_of: date | str, days: int
) -> DataFrame:
    """``value`` of ``facts`` per ``key`` and day, 0 where there is none.

    ``facts`` holds (``key``, day, ``value``), one row per pair.
    """
    grid = day_grid(dim, as_of, days)
    zero = F.lit(0).cast(facts.schema[value].dataType)
    return grid.join(facts, [key, "day"], "left").withColumn(value, F.coalesce(F.col(value), zero))
