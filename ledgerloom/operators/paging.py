"""Lists cut to a first part or to one page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.constants import PAGE_SIZE
from ledgerloom.operators.running import number_rows

#: pages starting beyond this many rows are found by row number, not by a top-k heap
SHALLOW_ROWS = 100_000

#: largest k for which Spark limits a ranking window before its shuffle
RANKED_ROWS = 1000


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows. ``order`` must end in a unique key."""
    return df.orderBy(*order).limit(k)


def top_k_per(
    df: DataFrame, keys: Sequence[str], k: int, *order: Column, levels: Sequence[Column] | None = None
) -> DataFrame:
    """First ``k`` rows per key.

    Up to ``RANKED_ROWS`` Spark keeps ``k`` rows per key and task before it shuffles. A
    longer list is cut by row number over ``levels``, so that no key is sorted whole.
    """
    if k <= RANKED_ROWS or levels is None:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        ranked = number_rows(df, order, levels, keys=keys, name="_rank")
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def clean_page(page: int | str | None) -> int:
    """Page number; anything below 1 or not a number means 1."""
    try:
        return max(int(page), 1)
    except (TypeError, ValueError):
        return 1


def page_slice(
    df: DataFrame,
    order: Sequence[Column],
    page: int | str | None = 1,
    size: int = PAGE_SIZE,
    levels: Sequence[Column] | None = None,
) -> DataFrame:
    """One page of ``df``, its rows in ``order``.

    With ``levels`` a page that lies deep is found by row number instead of sorting all rows before
    it; the page itself is sorted either way.
    """
    skip = (clean_page(page) - 1) * size
    if skip <= SHALLOW_ROWS or levels is None:
        return df.orderBy(*order).offset(skip).limit(size)
    numbered = number_rows(df, order, levels, name="_row")
    return numbered.filter(F.col("_row").between(skip + 1, skip + size)).drop("_row").orderBy(*order)


def page_count(rows: Column, size: int = PAGE_SIZE) -> Column:
    return F.ceil(rows / F.lit(size))


def page_window(page: Column, pages: Column) -> Column:
    """Page numbers offered around ``page``: four before, four after, within 1..pages."""
    first, last = F.greatest(page - 4, F.lit(1)), F.least(page + 4, pages)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
