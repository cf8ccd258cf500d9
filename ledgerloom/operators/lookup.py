"""Foreign key look-ups and header/line joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.predicates import visible


def fk_lookup(df: DataFrame, fk: str, dim: DataFrame, **columns: str | Column) -> DataFrame:
    """Left-join chosen ``columns`` (new name = dim column) of the row ``fk`` points to.

    No broadcast hint: a dimension is broadcast when its measured size allows, and
    joined by a shuffle with hot keys split otherwise.
    """
    picked = dim.select(
        F.col("id").alias("_fk"),
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()],
    )
    return df.join(picked, F.col(fk) == F.col("_fk"), "left").drop("_fk")


def lines_of(lines: DataFrame, fk: str, headers: DataFrame, **columns: str) -> DataFrame:
    """Lines with chosen columns of their header, headers filtered beforehand."""
    picked = headers.select(F.col("id").alias("_hid"), *[F.col(c).alias(n) for n, c in columns.items()])
    return lines.join(picked, F.col(fk) == F.col("_hid"), "inner").drop("_hid")


def visible_lines(lines: DataFrame, fk: str, headers: DataFrame) -> DataFrame:
    """Lines whose header is not hidden."""
    ids = headers.filter(visible()).select(F.col("id").alias("_hid"))
    return lines.join(ids, F.col(fk) == F.col("_hid"), "left_semi")
