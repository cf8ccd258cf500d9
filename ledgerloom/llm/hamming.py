"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has one bit for each component, set where it is above zero. Codes are cut into segments of up to
16 bits, each with a table from its value to the rows that have it. A query looks its segments up
with a growing number of flipped bits. Once i + 1 of the m segments are searched to radius a and the others to a - 1, every
code within distance m * a + i has been met (pigeonhole principle), so the search ends when the k-th verified
distance is no more than that. Nothing is estimated and no candidate is capped: the result is exact.

Defined results: vectors that cannot be searched take no part (see ``vectors.valid_vectors``); ties go to the smaller id; a
query's own id is no candidate; with fewer than k other rows all of them are returned; a row repeated under one id
is found as often as it is there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_value
from ledgerloom.llm.vectors import dealt, in_every_block, matrix, meet, ranked, valid_vectors

SEGMENT_BITS = 16
ROW_BLOCK = 16_384


class SegmentTables:
    """The segment tables of a block of codes (rows x bits, true or false)."""

    def __init__(self, bits: np.ndarray):
        self.n, self.width = bits.shape
        self.words = self.packed(bits)
        count = -(-self.width // SEGMENT_BITS)
        edges = np.linspace(0, self.width, count + 1).astype(int)
        self.edges = list(zip(edges[:-1], edges[1:]))
        self.order, self.begin = [], []
        for i in range(count):
            values = self.segment(bits, i)
            order = np.argsort(values, kind="stable")
            size = 1 << int(self.edges[i][1] - self.edges[i][0])
            self.order.append(order)
            self.begin.append(np.searchsorted(values[order], np.arange(size + 1)))
        self.flips = {}
        for width in {int(b - a) for a, b in self.edges}:
            masks = np.arange(1 << width, dtype=np.int64)
            ones = np.bitwise_count(masks)
            self.flips[width] = [masks[ones == r] for r in range(width + 1)]

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        padded = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
        return np.packbits(padded, axis=1).view(np.uint64)

    def segment(self, bits: np.ndarray, i: int) -> np.ndarray:
        a, b = self.edges[i]
        return bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64))

    def nearest(self, query: np.ndarray, k: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances that contain the k nearest of ``other``, all ties with the k-th included."""
        own = self.packed(query[None])[0]
        value = [int(self.segment(query[None], i)[0]) for i in range(len(self.edges))]
        seen = ~other
        rows, distances, count = [], [], np.zeros(self.width + 1, np.int64)
        k = min(k, int(other.sum()))
        covered = -1
        radius = 0
        while count[: covered + 1].sum() < k:
            for i, (a, b) in enumerate(self.edges):
                flips = self.flips[int(b - a)]
                if radius < len(flips):
                    buckets = value[i] ^ flips[radius]
                    begin, size = self.begin[i][buckets], self.begin[i][buckets + 1] - self.begin[i][buckets]
                    begin, size = begin[size > 0], size[size > 0]
                    if len(size):
                        skip = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                        met = self.order[i][skip + np.arange(size.sum())]
                        met = met[~seen[met]]
                        seen[met] = True
                        apart = np.bitwise_count(self.words[met] ^ own).sum(axis=1, dtype=np.int64)
                        rows.append(met)
                        distances.append(apart)
                        count += np.bincount(apart, minlength=self.width + 1)
                # segments up to i are searched to `radius`, the others to one less: whoever is not met yet
                # differs by at least (i + 1) * (radius + 1) + (m - i - 1) * radius bits
                covered = min(self.width, len(self.edges) * radius + i)
                if count[: covered + 1].sum() >= k:
                    break
            radius += 1
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(distances)


def _tables(rows: pa.Table) -> tuple[np.ndarray, SegmentTables]:
    return rows["vec_id"].to_numpy(), SegmentTables(matrix(rows["vector"]) > 0)


def _searcher(k: int):
    def run(index: tuple[np.ndarray, SegmentTables], queries: pa.Table) -> pa.Table:
        ids, tables = index
        found: list[list[np.ndarray]] = [[], [], []]
        for query_id, q in zip(queries["vec_id"].to_pylist(), matrix(queries["vector"]) > 0):
            at, apart = tables.nearest(q, k, ids != query_id)
            best = np.lexsort((ids[at], apart))[:k]
            found[0].append(np.full(len(best), query_id))
            found[1].append(ids[at[best]])
            found[2].append(apart[best])
        columns = [np.concatenate(f).astype(np.int64) if f else np.zeros(0, np.int64) for f in found]
        return pa.table(dict(zip(("query_id", "vec_id", "distance"), map(pa.array, columns))))

    return run


def nearest_codes(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id and Hamming distance of the ``k`` nearest codes for each row of which ``is_query`` holds."""
    rows = valid_vectors(vectors)
    queries = rows.filter(is_query)
    n_blocks = max(1, -(-rows.count() // ROW_BLOCK))
    found = meet(
        dealt(rows, n_blocks), in_every_block(queries, n_blocks), queries.count(), n_blocks,
        _tables, _searcher(k), "query_id long, vec_id long, distance long",
    )
    return ranked(found, k, F.asc("distance"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "distance")


by_value(__name__)
