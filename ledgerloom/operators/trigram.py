"""Substring search with an index of trigrams.

The index lists, for each column and each three consecutive characters of its text (ASCII letters folded), the ids of the rows
that have them, sorted by column and trigram; beside it is how long each list is. A text that contains a pattern has all of the
pattern's trigrams, so the rows on the shortest few of their lists are candidates; each is then tested as a scan would
test it. Trigrams that a row no longer has therefore do no harm: after a change only the new rows' trigrams are
added (``with_rows``).

A pattern without three literal characters in a row cannot use the index; it scans, with the same result. A list of a third
of all rows is only read if the pattern has no rarer trigram. Few candidates are looked up by their ids, so that only
the row groups that hold them are read; more are joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import _ascii_lower, any_contains, ascii_lower, raw_like

#: lists that are intersected for a pattern, the shortest ones
LISTS = 3
#: up to so many candidates are looked up by id
LOOKED_UP = 1_000
#: texts whose trigrams a task sorts when an index is written, about; left to Spark, their compressed size would decide
PART_ROWS = 100_000


class TextIndex(NamedTuple):
    #: column, gram, id
    postings: DataFrame
    #: column, gram, n
    sizes: DataFrame


def _grams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def postings(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, gram and id of the texts of ``rows`` (id and the columns)."""

    def of(name: str) -> DataFrame:
        # a look-ahead finds overlapping matches; (?s) lets a line break be a character
        text = ascii_lower(F.col(name).cast("string"))
        grams = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1)))
        return rows.select(F.lit(name).alias("column"), F.explode(grams).alias("gram"), "id")

    out = of(columns[0])
    for name in columns[1:]:
        out = out.unionAll(of(name))
    return out


def _sizes(listed: DataFrame) -> DataFrame:
    return listed.groupBy("column", "gram").agg(F.count("*").alias("n"))


def build(rows: DataFrame, columns: Sequence[str]) -> TextIndex:
    listed = postings(rows, columns)
    return TextIndex(listed, _sizes(listed))


def write_index(rows: DataFrame, columns: Sequence[str], path: str) -> None:
    """Store the index sorted, so that a list lies in few row groups; a long one is split over files."""
    parts = max(1, -(-rows.count() * len(columns) // PART_ROWS))
    listed = postings(rows, columns).repartitionByRange(parts, "column", "gram", "id").sortWithinPartitions("column", "gram", "id")
    listed.write.mode("errorifexists").parquet(f"{path}/postings")
    stored = rows.sparkSession.read.parquet(f"{path}/postings")
    _sizes(stored).repartitionByRange("column", "gram").sortWithinPartitions("column", "gram").write.mode("errorifexists").parquet(f"{path}/sizes")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(
        spark.read.schema("column string, gram string, id bigint").parquet(f"{path}/postings"),
        spark.read.schema("column string, gram string, n bigint").parquet(f"{path}/sizes"),
    )


def with_rows(index: TextIndex, rows: DataFrame, columns: Sequence[str]) -> TextIndex:
    """The index with the trigrams of added or changed rows."""
    new = postings(rows, columns)
    sizes = index.sizes.unionByName(_sizes(new)).groupBy("column", "gram").agg(F.sum("n").alias("n"))
    return TextIndex(index.postings.unionByName(new), sizes)


def candidates(index: TextIndex, column: str, literals: Sequence[str]) -> DataFrame | None:
    """Ids of the rows whose column may contain all literals, or None if no literal has three characters. An id may come up repeatedly."""
    grams = sorted({g for text in literals for g in _grams(_ascii_lower(text))})
    if not grams:
        return None
    found = index.sizes.filter((F.col("column") == column) & F.col("gram").isin(grams)).orderBy("n", "gram").collect()
    if len(found) < len(grams):  # some trigram is in no row
        return index.postings.select("id").limit(0)
    rarest = [r["gram"] for r in found[:LISTS]]
    # joined rather than counted by id: a task would hold all ids of its part of a list at once
    lists = [index.postings.filter((F.col("column") == column) & (F.col("gram") == g)).select("id") for g in rarest]
    ids = lists[0]
    for longer in lists[1:]:
        ids = ids.join(longer, "id", "left_semi")
    return ids


def _verified(df: DataFrame, ids: DataFrame | None, test: Column) -> DataFrame:
    if ids is None:
        return df.filter(test)
    few = [r["id"] for r in ids.limit(LOOKED_UP + 1).collect()]
    if len(few) <= LOOKED_UP:
        return df.filter(F.col("id").isin(sorted({i for i in few if i is not None})) & test) if few else df.limit(0)
    return df.join(ids, "id", "left_semi").select(*df.columns).filter(test)


def _any(index: TextIndex, columns: Sequence[str], literals: Callable[[str], Sequence[str]]) -> DataFrame | None:
    out = None
    for column in columns:
        ids = candidates(index, column, literals(column))
        if ids is None:
            return None
        out = ids if out is None else out.unionAll(ids)
    return out


def contains(df: DataFrame, index: TextIndex, text: str, *columns: str) -> DataFrame:
    """The rows of which any column contains the text, as ``any_contains`` finds them."""
    return _verified(df, _any(index, columns, lambda _: [text]), any_contains(text, *columns))


def contains_all(df: DataFrame, index: TextIndex, texts: dict[str, str]) -> DataFrame:
    """The rows of which every named column contains its text."""
    ids, test = None, F.lit(True)
    for column, text in texts.items():
        test = test & any_contains(text, column)
        own = candidates(index, column, [text])
        if own is not None:
            ids = own if ids is None else ids.join(own, "id", "left_semi")
    return _verified(df, ids, test)


def like(df: DataFrame, index: TextIndex, patterns: dict[str, str]) -> DataFrame:
    """The rows of which any named column is LIKE its pattern, as ``raw_like`` finds them."""
    test = F.lit(False)
    for column, pattern in patterns.items():
        test = test | raw_like(F.col(column), pattern)
    return _verified(df, _any(index, list(patterns), lambda c: re.split("[%_]", patterns[c])), test)
