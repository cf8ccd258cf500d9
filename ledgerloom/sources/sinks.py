"""Report files and row documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import SALES_REPORT_HEADER, STOCK_REPORT_HEADER
from ledgerloom.functions.text import pipe_row

BOM = "﻿"


def _write_csv(
    df: DataFrame, path: str, header: Sequence[str], order: Sequence[Column], single_file: bool
) -> None:
    """CSV with a UTF-8 byte order mark and a heading line in every file.

    Rows are range-partitioned on the report order; part files in name order make up the
    whole report. ``single_file`` is for reports known to be small: one task writes them.
    """
    names = [BOM + header[0], *header[1:]]
    ordered = df.repartition(1).sortWithinPartitions(*order) if single_file else df.orderBy(*order)
    columns = [c for c in df.columns if c != "ordinal"]
    out = ordered.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
    out.write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_sales_report_csv(report: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the rows of ``reports.sales_report``, footer last."""
    _write_csv(report, path, SALES_REPORT_HEADER, [F.col("ordinal")], single_file)


def write_stock_report_csv(report: DataFrame, path: str, single_file: bool = False) -> None:
    """Write one container's ``reports.stock_report``."""
    rows = report.select(
        F.col("no").alias("ordinal"),
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            for c in ("no", "name", "barcode", "size", "stock", "depot_stock", "status")
        ],
    )
    _write_csv(rows, path, STOCK_REPORT_HEADER, [F.col("ordinal")], single_file)


def to_json_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Each row as one JSON document, nulls kept."""
    picked = columns or tuple(df.columns)
    return df.select(F.to_json(F.struct(*picked), {"ignoreNullFields": "false"}).alias("doc"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def pipe_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Each row as one ``a|b|c`` line."""
    return df.select(pipe_row(*[F.col(c) for c in columns or df.columns]).alias("line"))
