"""Reading and writing the ledger tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.schemas import DDL, LINE_HEADER, TABLES, conform


class Tables(Mapping[str, DataFrame]):
    """Table name -> DataFrame, each built on first use.

    A query over two tables never lists or opens the other thirteen.
    """

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def replaced(self, **tables: DataFrame) -> Tables:
        """A copy with some tables swapped, as a change job returns it."""
        out = Tables(self._makers)
        out._made = {**self._made, **tables}
        out._makers.update({name: (lambda df=df: df) for name, df in tables.items()})
        return out


def scan_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Full scan of one table under its declared schema (no inference)."""
    return spark.read.schema(DDL[table]).parquet(f"{path}/{table}")


def scan_pruned(df: DataFrame, *columns: str) -> DataFrame:
    """Keep some columns; the reader fetches only those."""
    return df.select(*columns)


def load_tables(spark: SparkSession, path: str) -> Tables:
    """All ledger tables from ``path/<table>`` Parquet folders."""
    return Tables({name: (lambda n=name: scan_table(spark, path, n)) for name in TABLES})


def load_jdbc(
    spark: SparkSession, url: str, prefix: str = "", *, partitions: int = 64, **options: str
) -> Tables:
    """All ledger tables from an SQL store.

    Reads in parallel ``id`` ranges; the bounds come from a pushed-down min/max.
    """

    def read(name: str) -> DataFrame:
        source = spark.read.format("jdbc").options(url=url, **options)
        low, high = (
            source.option("query", f"select min(id) lo, max(id) hi from {prefix}{name}").load().first()
        )
        ranged = source.option("dbtable", f"{prefix}{name}")
        if low is not None and high > low:
            ranged = ranged.options(
                partitionColumn="id", lowerBound=low, upperBound=high, numPartitions=partitions
            )
        return conform(ranged.load(), name)

    return Tables({name: (lambda n=name: read(n)) for name in TABLES})


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write a new snapshot; never in place, so a lost job leaves the old one whole."""
    for name, df in tables.items():
        conform(df, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def write_bucketed(tables: Mapping[str, DataFrame], database: str, path: str, buckets: int) -> None:
    """Store each ledger's header and lines bucketed on the order key.

    Header/line joins and per-header sums over these tables then need no shuffle.
    """
    keys = {header: "id" for header, _ in LINE_HEADER.values()}
    keys |= {line: fk for line, (_, fk) in LINE_HEADER.items()}
    for name, key in keys.items():
        (
            conform(tables[name], name)
            .write.mode("errorifexists")
            .bucketBy(buckets, key)
            .sortBy(key)
            .option("path", f"{path}/{name}")
            .saveAsTable(f"{database}.{name}")
        )
