"""Snapshots of the ledger tables that share their unchanged files.

A store is a folder with the tables' Parquet files below ``data`` and one manifest for each version below ``versions``: the files
that make up each table, with the ids they hold. Files are never changed. A commit takes what a change job
added, changed and deleted, finds the files that hold those ids, writes their rows anew (without the deleted
ones, with the changed ones) and lists all other files again. So a change of a few rows writes a few files, and every
earlier version stays readable as it was.

Which files hold an id is found in two steps: the manifest's lowest and highest ids leave out most files, then the id
column of the others is read. Files are written in ranges of ids, so new rows go to new files and ranges overlap
little. The driver sees lists of files, never of rows. A number of rows for each file is asked for; a table that would have more
than ``MAX_FILES`` such files has larger ones, up to ``FILE_ROWS``, as each file costs a task, a place in
the manifest and a path at every reading.

A version is there once its manifest is complete. Writing a manifest fails if its folder exists, so of two commits on
one version the second fails and has to start again from the newer one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schemas import DDL, TABLES, conform
from ledgerloom.session import cut
from ledgerloom.sources.tables import Tables

#: rows of one file, about
FILE_ROWS = 1_000_000
#: files of fewer rows than that are made larger where a table would have more files than this
MAX_FILES = 256

_MANIFEST = "table string, file string, n bigint, low bigint, high bigint"


class Delta(NamedTuple):
    """What a change did to a table: whole rows added or changed, and the ids of rows that are gone."""

    rows: DataFrame | None = None
    deleted: DataFrame | None = None


def _folder(spark: SparkSession, path: str):
    """(Hadoop file system, path)."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions of a store, in order."""
    fs, where = _folder(spark, f"{root}/versions")
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where)]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("v")) for p in done)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """table, file (below the root), n (rows), low and high (ids) of a version, the latest by default."""
    if version is None:
        version = max(versions(spark, root))
    return spark.read.schema(_MANIFEST).parquet(f"{root}/versions/v{version}")


def read_files(spark: SparkSession, root: str, table: str, files: Iterable[str]) -> DataFrame:
    """The rows of some files of a table."""
    paths = [f"{root}/{f}" for f in files]
    return spark.read.schema(DDL[table]).parquet(*paths) if paths else spark.createDataFrame([], DDL[table])


def _files(listed: DataFrame, table: str, test: Column | None = None) -> list[str]:
    rows = listed.filter(F.col("table") == table)
    return [r["file"] for r in (rows if test is None else rows.filter(test)).select("file").orderBy("low", "file").collect()]


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Tables:
    """The tables of a version, each read when it is first used."""
    listed = manifest(spark, root, version)
    return Tables({name: (lambda n=name: read_files(spark, root, n, _files(listed, n))) for name in TABLES})


def _rows_of_a_file(n: int, file_rows: int) -> int:
    """About how many rows a file of a table of ``n`` rows has, if ``file_rows`` are asked for."""
    return max(file_rows, min(FILE_ROWS, -(-n // MAX_FILES)))


def _write(rows: DataFrame, root: str, table: str, n_files: int) -> DataFrame:
    """Write rows in ranges of ids; the manifest entries of the files."""
    spark = rows.sparkSession
    folder = f"data/{table}/{uuid.uuid4().hex}"
    ranged = conform(rows, table).repartitionByRange(max(1, n_files), "id").sortWithinPartitions("id")
    ranged.write.mode("errorifexists").parquet(f"{root}/{folder}")
    written = spark.read.schema(DDL[table]).parquet(f"{root}/{folder}")
    by_file = written.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"))
    stats = by_file.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    return stats.select(F.lit(table).alias("table"), F.concat(F.lit(f"{folder}/"), "name").alias("file"), "n", "low", "high")


def _list(entries: list[DataFrame], spark: SparkSession, root: str, version: int) -> int:
    whole = spark.createDataFrame([], _MANIFEST)
    for e in entries:
        whole = whole.unionByName(e)
    whole.coalesce(1).write.mode("errorifexists").parquet(f"{root}/versions/v{version}")
    return version


def write_store(tables: Mapping[str, DataFrame], root: str, file_rows: int = FILE_ROWS) -> int:
    """Write the first version of a store."""
    spark = next(iter(tables.values())).sparkSession
    if versions(spark, root):
        raise ValueError(f"{root} is a store already")
    entries = []
    for name, df in tables.items():
        n = df.count()
        entries.append(_write(df, root, name, -(-n // _rows_of_a_file(n, file_rows))))
    return _list(entries, spark, root, 1)


def _holding(spark: SparkSession, root: str, table: str, listed: DataFrame, ids: DataFrame) -> list[str]:
    """The files of a table that hold any of the ids."""
    span = ids.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if span["low"] is None:
        return []
    near = _files(listed, table, (F.col("low") <= span["high"]) & (F.col("high") >= span["low"]))
    if not near:
        return []
    rows = read_files(spark, root, table, near).select("id", F.col("_metadata.file_path").alias("_path"))
    inside = (F.col("id") >= span["low"]) & (F.col("id") <= span["high"])
    paths = rows.filter(inside).join(ids, "id", "left_semi").select("_path").distinct().collect()
    names = {"/".join(r["_path"].split("/")[-2:]) for r in paths}
    return [f for f in near if "/".join(f.split("/")[-2:]) in names]


def commit(spark: SparkSession, root: str, changes: Mapping[str, Delta], base: int | None = None, file_rows: int = FILE_ROWS) -> int:
    """Write a new version on top of ``base`` (the latest by default) that differs by ``changes``; its number.

    A row whose id the table has replaces that row, any other is new. Deleting an id that is not there changes nothing. A
    row of ``rows`` wins over the same id in ``deleted``.
    """
    done = versions(spark, root)
    base = max(done) if base is None else base
    listed = manifest(spark, root, base)
    kept, added = listed, []
    for table, delta in changes.items():
        none = spark.createDataFrame([], DDL[table])
        # files on shared storage, as the rows are read three times
        rows = cut(none if delta.rows is None else conform(delta.rows, table))
        gone = none.select("id") if delta.deleted is None else delta.deleted.select(F.col("id").cast("bigint").alias("id"))
        touched = cut(rows.select("id").unionAll(gone).distinct())
        files = _holding(spark, root, table, listed, touched)
        size = listed.filter(F.col("table") == table).agg(F.sum("n").alias("n"), F.max("high").alias("high")).first()
        per_file = _rows_of_a_file(size["n"] or 0, file_rows)
        if files:
            old = read_files(spark, root, table, files)
            kept_rows = old.join(touched, "id", "left_anti")
            changed = rows.join(old.select("id"), "id", "left_semi")
            held = listed.filter(F.col("file").isin(files)).agg(F.sum("n")).first()[0]
            added.append(_write(kept_rows.unionByName(changed), root, table, max(1, round(held / per_file))))
            rows = rows.join(old.select("id"), "id", "left_anti")
            kept = kept.filter(~F.col("file").isin(files))
        # ids beyond all others get files of their own, so that no file spans the gap between
        above = F.lit(True) if size["high"] is None else F.col("id") > size["high"]
        for part in (rows.filter(~above), rows.filter(above)):
            if n_new := part.count():
                added.append(_write(part, root, table, -(-n_new // max(per_file, _rows_of_a_file(n_new, file_rows)))))
    return _list([kept, *added], spark, root, base + 1)
