"""Running totals and row numbers that no single task has to compute alone.

A plain window sorts each key's whole history in one task. Here the caller also names
*levels*: coarse-to-fine columns that follow the sort order (say the day, then a block
of ids). Each level is summed first, the sums are accumulated level by level, and only
the rows inside one finest block meet in one task. The result equals the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: a block holds 2**20 consecutive ids; one task sorts the rows of one block
BLOCK_BITS = 20


def id_block(column: str | Column, bits: int = BLOCK_BITS) -> Column:
    """Number of the block an integer id falls into."""
    return F.shiftright(column, bits)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums of ``totals`` per ``keys``, in ``order``.

    ``levels`` must not decrease along ``order`` (negate them for a descending one).
    Keys and levels must not be NULL; ``order`` must be total within a key.
    """
    names = [f"_lv{i}" for i in range(len(levels))]
    df = df.select("*", *[c.alias(n) for n, c in zip(names, levels)])
    keys = list(keys)

    # Exclusive offset of every block: what all earlier blocks of its key add up to.
    block = df.groupBy(*keys, *names).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
    offsets = block
    for depth in range(len(names), 0, -1):
        # Offset of the level-`depth` group among its siblings under one parent group.
        group = keys + names[:depth]
        sums = block.groupBy(*group).agg(*[F.sum(f"_s_{n}").alias(f"_g_{n}") for n in totals])
        before = (
            Window.partitionBy(*group[:-1]) if group[:-1] else Window.partitionBy()
        ).orderBy(names[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(
            *group, *[F.coalesce(F.sum(f"_g_{n}").over(before), F.lit(0)).alias(f"_o{depth}_{n}") for n in totals]
        )
        offsets = offsets.join(sums, group)
    offsets = offsets.select(
        *keys,
        *names,
        *[
            sum((F.col(f"_o{d}_{n}") for d in range(1, len(names) + 1)), F.lit(0)).alias(f"_off_{n}")
            for n in totals
        ],
    )

    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = df.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in totals.items()])
    kept = [c for c in df.columns if c not in names]
    return rows.join(offsets, keys + names).select(
        *kept, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in totals]
    )


def number_by_range(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Consecutive numbers from 1 over all rows, whatever the values of ``order`` are.

    Rows are dealt out by ranges of ``order`` and kept, each range is numbered by one task, and the
    ranges' sizes are added up. ``order`` must be total.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(*order)
    numbered = ranged.withColumn("_own", F.row_number().over(own).cast("bigint")).join(sizes, "_range")
    return numbered.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    levels: Sequence[Column],
    keys: Sequence[str] = (),
    name: str = "row_no",
    start: int = 1,
) -> DataFrame:
    """Consecutive row numbers from ``start``, overall or per ``keys``."""
    numbered = running_total(df, keys, levels, order, {name: F.lit(1).cast("bigint")})
    if start != 1:
        numbered = numbered.withColumn(name, F.col(name) + (start - 1))
    return numbered
