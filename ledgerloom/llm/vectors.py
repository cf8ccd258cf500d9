"""What the vector searches share: valid vectors, blocks of queries against blocks of rows, the final ranking.

A search compares a stated set of queries with all rows. Rows are dealt into blocks of bounded size, and a task holds
one block while it streams the queries sent there past it, so no task's memory grows with the table.
From every block a query's best few rows go on to the final ranking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_value

#: so many queries are streamed past one copy of a block, and into so many tasks blocks are dealt at most
QUERIES_AT_ONCE, MOST_TASKS = 32_768, 20_000


def valid_vectors(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that can be searched.

    Rows with a null id and vectors that are null, zero, or hold null or non-finite components take no part; of
    several dimensions in a table, the one most rows have (the larger on a tie) is searched.
    """
    limit = float("inf")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(name).cast("array<double>").alias("vector"))
    fine = rows.filter(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
        & F.exists("vector", lambda x: x != 0)
    )
    common = fine.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return fine.filter(F.size("vector") == (common["dim"] if common else 0))


def dealt(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Rows with the ``block`` each is dealt to. Equal rows are dealt apart, as a row's place in its partition counts too."""
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("long"))


def in_every_block(queries: DataFrame, n_blocks: int) -> DataFrame:
    return queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))


def meet(rows: DataFrame, queries: DataFrame, n_queries: int, n_blocks: int, build: Callable, search: Callable, schema: str) -> DataFrame:
    """``search(build(rows of a block), some queries of the block)`` (Arrow tables) for all blocks and their queries.

    Both sides carry ``block``. A row is shuffled once for every ``QUERIES_AT_ONCE`` queries, a query once for each block
    it is sent to. A task reads a block's rows, builds what is searched once and then streams the queries past it.
    """
    parts = max(1, -(-n_queries // QUERIES_AT_ONCE))
    held = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_asks", F.lit(False))
    asking = queries.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("_asks", F.lit(True))
    both = held.unionByName(asking, allowMissingColumns=True)
    tasks = min(2 * n_blocks * parts, MOST_TASKS)
    return both.repartition(tasks, "block", "_part").sortWithinPartitions("block", "_part", "_asks").mapInArrow(_streamed(build, search), schema)


def _streamed(build: Callable, search: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        place, held, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("block", "_part", "_asks")], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                if begin == end:
                    continue
                if (here := tuple(keys[begin][:2])) != place:
                    place, held, index = here, [], None
                if not keys[begin][2]:
                    held.append(batch.slice(begin, end - begin))
                    continue
                if index is None and held:
                    index, held = build(pa.Table.from_batches(held).combine_chunks()), []
                if index is not None:
                    yield from search(index, pa.Table.from_batches([batch.slice(begin, end - begin)])).to_batches()

    return run


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def ranked(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query with their rank from 1."""
    by = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


by_value(__name__)
