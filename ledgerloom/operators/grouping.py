"""Rows collected under their group, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.running import number_rows

#: rows of one part
PART_ROWS = 1_000


def collect_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], levels: Sequence[Column], columns: Sequence[str], size: int = PART_ROWS
) -> DataFrame:
    """keys, part (from 0), n and rows: the ``columns`` of each group's rows in ``order``, ``size`` to a part.

    A group of any size is numbered without sorting it in one task (see ``number_rows``), and no cell holds
    more than ``size`` rows. ``order`` must be total within a group, ``levels`` follow it.
    """
    numbered = number_rows(df.select(*keys, *columns), order, levels, keys=keys, name="_row")
    part = F.expr(f"cast((_row - 1) div {int(size)} as bigint)").alias("part")
    rows = F.array_sort(F.collect_list(F.struct("_row", F.struct(*columns).alias("row"))))
    return numbered.groupBy(*keys, part).agg(F.count("*").alias("n"), F.transform(rows, lambda r: r["row"]).alias("rows"))
