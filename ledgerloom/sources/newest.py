"""Newest rows and deep pages of a stored table, read from the few files that hold them.

A snapshot's manifest has the lowest and highest id and the number of rows of each file. Files whose ids overlap form a
group; groups follow one another by id, so the rows of a group have known places in the list of all rows, newest first. Within a group,
a file's ids bound the places of its rows.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.constants import PAGE_SIZE
from ledgerloom.operators.paging import clean_page, top_k
from ledgerloom.sources.snapshots import manifest, read_files


class Group(NamedTuple):
    """Files whose ids overlap, and how many rows are in newer groups."""

    files: list[str]
    low: int
    n: int
    before: int


def directory(spark: SparkSession, root: str, table: str, version: int | None = None) -> list[Group]:
    """The groups of a table's files, newest first. Its length is at most the number of files."""
    listed = manifest(spark, root, version).filter(F.col("table") == table).orderBy(F.desc("high"), "file").collect()
    groups: list[Group] = []
    for r in listed:
        if groups and r["high"] >= groups[-1].low:
            last = groups.pop()
            groups.append(Group([*last.files, r["file"]], min(last.low, r["low"]), last.n + r["n"], last.before))
        else:
            before = groups[-1].before + groups[-1].n if groups else 0
            groups.append(Group([r["file"]], r["low"], r["n"], before))
    return groups


class File(NamedTuple):
    """A file, the least number of rows of the table that are newer than all of its own, and the most that are as new as any of its."""

    name: str
    n: int
    high: int
    newer: int
    reach: int


def _files(spark: SparkSession, root: str, table: str, version: int | None) -> list[File]:
    """The files of a table, those with the newest rows first."""
    listed = manifest(spark, root, version).filter(F.col("table") == table).orderBy(F.desc("high"), "file").collect()
    by_low = sorted((r["low"], r["n"]) for r in listed)
    lows, below = [low for low, _ in by_low], [0, *accumulate(n for _, n in by_low)]
    highs, through = [-r["high"] for r in listed], [0, *accumulate(r["n"] for r in listed)]
    return [
        File(r["file"], r["n"], r["high"], below[-1] - below[bisect_right(lows, r["high"])], through[bisect_right(highs, -r["low"])])
        for r in listed
    ]


def newest(
    spark: SparkSession, root: str, table: str, k: int, where: Column | None = None, version: int | None = None
) -> DataFrame:
    """The ``k`` rows with the largest ids, newest first; of those that ``where`` holds for.

    Without a test the manifest tells which files may have them. With one, files are searched from the newest on, twice as
    many each time, until ``k`` rows are found whose ids are above all ids of the files not read.
    """
    files = _files(spark, root, table, version)
    if where is None:
        return top_k(read_files(spark, root, table, [f.name for f in files if f.newer < k]), k, F.col("id").desc())
    taken = 1
    while True:
        rows = read_files(spark, root, table, [f.name for f in files[:taken]]).filter(where)
        if taken < len(files):
            rows = rows.filter(F.col("id") > files[taken].high)
        if taken >= len(files) or rows.limit(k).count() >= k:
            return top_k(rows, k, F.col("id").desc())
        taken *= 2


def page(
    spark: SparkSession, root: str, table: str, number: int | str | None = 1, size: int = PAGE_SIZE, version: int | None = None
) -> DataFrame:
    """One page of all rows, newest first, from the files that may hold it: however deep it is, it sorts their rows only.

    Files that certainly lie before it are counted, those that certainly lie behind it are left out, also where
    the ids of many files overlap in a chain.
    """
    skip = (clean_page(number) - 1) * size
    files = _files(spark, root, table, version)
    before = sum(f.n for f in files if f.reach <= skip)
    hit = [f.name for f in files if f.newer < skip + size and f.reach > skip]
    rows = read_files(spark, root, table, hit).orderBy(F.col("id").desc())
    return rows.offset(skip - before).limit(size) if hit else rows


def page_total(spark: SparkSession, root: str, table: str, size: int = PAGE_SIZE, version: int | None = None) -> int:
    """The number of pages, from the manifest."""
    groups = directory(spark, root, table, version)
    return -(-(groups[-1].before + groups[-1].n) // size) if groups else 0
