"""Ledgers stored by month, headers and lines alike.

A line lies in the month of its header, so a search over a period reads the months of that period of both tables, and
a join of headers with their lines prunes the lines' months by the headers it finds. Within a month rows are sorted by id into
files of ranges of ids; bloom filters on ids, header keys and codes leave out the row groups that cannot hold an
exact value. Headers without a date, and lines without a header, are in month 0.

This is a layout for reading, like buckets: it is written as a whole from the tables or a snapshot of them.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schemas import DDL, LINE_HEADER, TABLES, conform
from ledgerloom.sources.tables import Tables, scan_table

MONTH = "month"


def month_of(moment: Column) -> Column:
    return F.coalesce(F.year(moment) * 100 + F.month(moment), F.lit(0)).cast("int")


def _write(df: DataFrame, path: str, *bloom: str) -> None:
    writer = df.repartitionByRange(MONTH, "id").sortWithinPartitions(MONTH, "id").write.partitionBy(MONTH).mode("errorifexists")
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def write_clustered(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write all tables, the three ledgers by month."""
    for line, (header, fk) in LINE_HEADER.items():
        heads = conform(tables[header], header).withColumn(MONTH, month_of(F.col("date")))
        _write(heads, f"{path}/{header}", "id", "code")
        dated = heads.select(F.col("id").alias("_hid"), MONTH)
        lines = conform(tables[line], line).join(dated, F.col(fk) == F.col("_hid"), "left").drop("_hid")
        _write(lines.withColumn(MONTH, F.coalesce(MONTH, F.lit(0))), f"{path}/{line}", "id", fk)
    ledgers = {name for pair in LINE_HEADER.items() for name in (pair[0], pair[1][0])}
    for name in TABLES:
        if name in tables and name not in ledgers:
            conform(tables[name], name).write.mode("errorifexists").parquet(f"{path}/{name}")


def read_clustered(spark: SparkSession, path: str) -> Tables:
    """The tables; headers and lines of the ledgers have their ``month`` as a last column."""
    ledgers = {name for pair in LINE_HEADER.items() for name in (pair[0], pair[1][0])}

    def read(name: str) -> DataFrame:
        if name not in ledgers:
            return scan_table(spark, path, name)
        return spark.read.schema(f"{DDL[name]}, {MONTH} int").parquet(f"{path}/{name}")

    return Tables({name: (lambda n=name: read(n)) for name in TABLES})


def within(t: Mapping[str, DataFrame], header: str, start: date, end: date) -> Mapping[str, DataFrame]:
    """Tables with only the months from ``start`` to ``end`` of one ledger; as they are if it is not stored by month."""
    if MONTH not in t[header].columns:
        return t
    line = next(n for n, (h, _) in LINE_HEADER.items() if h == header)
    months = F.col(MONTH).between(start.year * 100 + start.month, end.year * 100 + end.month)
    return t.replaced(**{name: t[name].filter(months) for name in (header, line) if MONTH in t[name].columns})
