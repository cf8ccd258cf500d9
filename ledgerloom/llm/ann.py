"""Approximate nearest neighbours with randomly rotated one-bit codes, in a coarse partition.

*Partition.* Centroids are fitted on a sample of at most ``FIT_CELLS`` components (the rows with the smallest hashes); every
row of the table belongs to its nearest one. Partitions are dealt into blocks of bounded size.

*Codes.* A row's residual to its centroid is normalised and turned by one random rotation (padded to ``CODE_BITS``
dimensions); the signs are its code. Beside the packed bits a row keeps its partition and two scalars: the residual's length,
and the product of the code's unit vector with the turned residual, which corrects the estimate.

*Routing.* Of each query the products with the sample give its k-th best there, a floor that the true k-th cannot be under,
and the spread of its products within each partition. From those and the partitions' sizes follows how many of
the k nearest each partition may be expected to hold. A query is sent to the partitions that together hold ``SHARE`` of
them, and to every one that is more likely than not to hold one. So clustered tables are searched in few partitions, and a
table without any structure in nearly all; rows of the sample that reach the floor count wherever they lie, so a query
always has its k rows. With ``exact`` a query goes to all partitions that the triangle inequality
(Cauchy-Schwarz on the residuals' largest length) cannot rule out, and every row there is compared.

*Search.* In a block the turned query's product with the unpacked signs, divided by the correction, estimates the
inner product without bias; the correction also bounds the error (``CONFIDENCE`` standard deviations). The larger of the
floor and of the k-th largest lower bound is a threshold: rows whose upper bound reaches it are compared in double precision.

Defined results: rows that cannot be searched take no part (see ``vectors.valid_vectors``; null ids are among them); a query's
own id is no candidate; ties go to the smaller id, so equal vectors rank by id; a row repeated under one id is found as
often as it is there; with fewer than k other rows all of them are returned; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_value
from ledgerloom.llm.vectors import matrix, meet, ranked, valid_vectors
from ledgerloom.session import cut

CODE_BITS = 256
CONFIDENCE = 3.0
SHARE = 0.99
FIT_CELLS = 1 << 20
PARTITION_ROWS, MOST_PARTITIONS = 1_024, 1_024
#: unpacked signs (or components) of a block
BLOCK_CELLS = 1 << 19
_ROUNDS = 8
_SEED = 20240229


def rotation(dim: int, bits: int) -> np.ndarray:
    """dim x bits: orthonormal rows drawn at random, the same in every task."""
    drawn = np.random.default_rng(_SEED + dim).standard_normal((bits, bits))
    return np.linalg.qr(drawn)[0][:, :dim].T.copy()


def code_bits(dim: int) -> int:
    return max(CODE_BITS, -(-dim // 64) * 64)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - (centroids * centroids).sum(axis=1) / 2).argmax(axis=1)


def fit_centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` centroids of the sample by Lloyd's rounds; those that no row is nearest to are left out."""
    n = min(n, max(1, len(sample) // 8))
    centroids = sample[np.random.default_rng(_SEED).choice(len(sample), n, replace=False)] if len(sample) else sample
    for _ in range(_ROUNDS if n > 1 else 1):
        own = nearest_centroid(sample, centroids)
        count = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = sums[count > 0] / count[count > 0][:, None]
    return centroids


class Coarse:
    """What routing needs: centroids, the sample in order of its partitions, sizes and largest residuals of the partitions."""

    def __init__(self, centroids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, sizes: np.ndarray, radius: np.ndarray):
        own = nearest_centroid(sample, centroids)
        order = np.argsort(own, kind="stable")
        self.centroids, self.sizes, self.radius = centroids, sizes, radius
        self.sample, self.sample_ids, self.own = sample[order], sample_ids[order], own[order]
        self.held = np.flatnonzero(np.bincount(own, minlength=len(centroids)))
        self.begin = np.searchsorted(self.own, self.held)
        self.in_sample = np.diff([*self.begin, len(own)])

    def floor_and_spread(self, queries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query: the k-th best product in the sample; per query and partition: mean and deviation of the products."""
        centre = queries @ self.centroids.T
        spread = np.linalg.norm(queries, axis=1)[:, None] * self.radius / np.sqrt(queries.shape[1])
        products = queries @ self.sample.T
        if len(self.held):
            rest = products - centre[:, self.own]
            squares = np.add.reduceat(rest * rest, self.begin, axis=1)
            enough = self.in_sample > 4
            spread[:, self.held[enough]] = np.sqrt(squares[:, enough] / self.in_sample[enough])
        products[ids[:, None] == self.sample_ids] = -np.inf
        floor = np.partition(products, -k, axis=1)[:, -k] if products.shape[1] >= k else np.full(len(queries), -np.inf)
        return floor, centre, np.maximum(spread, 1e-12)

    def expected(self, level: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """How many rows of each partition may be expected above a level, by the normal tail."""
        z = (level[:, None] - centre) / spread
        tail = 0.5 * np.exp(-0.717 * np.abs(z) - 0.416 * z * z)
        return self.sizes * np.where(z >= 0, tail, 1 - tail)

    def partitions(self, queries: np.ndarray, ids: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """(queries x partitions: is it visited, floor of each query's k-th best product)."""
        floor, centre, spread = self.floor_and_spread(queries, ids, k)
        slack = 1e-9 * (1 + np.abs(floor))
        floor = np.where(np.isfinite(floor), floor - slack, -np.inf)
        reach = centre + np.linalg.norm(queries, axis=1)[:, None] * self.radius * (1 + 1e-9) + 1e-9
        can = (reach >= floor[:, None]) & (self.sizes > 0)
        if exact or self.sizes.sum() <= k + 1:
            return can, floor
        low, high = (centre - 9 * spread).min(axis=1), (centre + 9 * spread).max(axis=1)
        for _ in range(40):  # the level that k rows may be expected above
            level = (low + high) / 2
            over = self.expected(level, centre, spread).sum(axis=1) > k
            low, high = np.where(over, level, low), np.where(over, high, level)
        hits = np.where(can, self.expected(np.maximum(low, floor), centre, spread), 0.0)
        order = np.argsort(-hits, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(hits, order, axis=1), axis=1)
        needed = np.zeros_like(can)
        np.put_along_axis(needed, order, sums - np.take_along_axis(hits, order, axis=1) < SHARE * sums[:, -1:], axis=1)
        needed[np.arange(len(needed)), order[:, 0]] = True
        return can & (needed | (hits > 0.5)), floor


def _coder(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        bits = code_bits(centroids.shape[1])
        turn = rotation(centroids.shape[1], bits)
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            own = nearest_centroid(x, centroids)
            rest = x - centroids[own]
            norm = np.sqrt((rest * rest).sum(axis=1))
            turned = (rest / np.where(norm > 0, norm, 1.0)[:, None]) @ turn
            fit = np.abs(turned).sum(axis=1) / np.sqrt(bits)
            packed = np.packbits(turned > 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(own), pa.array([p.tobytes() for p in packed], pa.binary()),
                    pa.array(norm), pa.array(np.where(fit > 0, fit, 1.0)),
                ],
                ["vec_id", "vector", "partition", "code", "norm", "fit"],
            )

    return run


def index(vectors: DataFrame) -> tuple[DataFrame, Coarse | None]:
    """Every searchable vector with its partition, code and correction scalars, kept on shared storage; and the partition."""
    rows = valid_vectors(vectors)
    first = rows.select(F.size("vector").alias("dim")).first()
    schema = "vec_id long, vector array<double>, partition long, code binary, norm double, fit double"
    if first is None:
        return rows.sparkSession.createDataFrame([], schema), None
    n_fit = max(16, FIT_CELLS // first["dim"])
    picked = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(n_fit).collect()
    sample, sample_ids = np.array([r["vector"] for r in picked]), np.array([r["vec_id"] for r in picked])
    total = rows.count()
    centroids = fit_centroids(sample, min(MOST_PARTITIONS, -(-total // PARTITION_ROWS)))
    coded = cut(rows.mapInArrow(_coder(centroids), schema))
    sizes, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in coded.groupBy("partition").agg(F.count("*").alias("n"), F.max("norm").alias("radius")).collect():
        sizes[r["partition"]], radius[r["partition"]] = r["n"], r["radius"]
    return coded, Coarse(centroids, sample, sample_ids, sizes, radius)


def _router(coarse: Coarse, blocks: np.ndarray, k: int, exact: bool):
    """Sends queries to the blocks of the partitions they are to visit."""
    begin = np.concatenate([[0], np.cumsum(blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                visits, floor = coarse.partitions(matrix(part.column(1)), part.column(0).to_numpy(zero_copy_only=False), k, exact)
                query, partition = np.nonzero(visits)
                times = blocks[partition]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                query, partition = np.repeat(query, times), np.repeat(partition, times)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(query)) for c in part.columns), pa.array(floor[query]), pa.array(begin[partition] + nth)],
                    ["vec_id", "vector", "floor", "block"],
                )

    return run


def _from_sample(coarse: Coarse, k: int, exact: bool):
    """The rows of the sample that reach the floor, wherever they lie. With them a query always has k rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, q = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1))
                floor = coarse.partitions(q, ids, k, exact)[1]
                reaches = (q @ coarse.sample.T >= floor[:, None]) & (ids[:, None] != coarse.sample_ids)
                query, row = np.nonzero(reaches)
                score = (coarse.sample[row] * q[query]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[query]), pa.array(coarse.sample_ids[row]), pa.array(score)], ["query_id", "vec_id", "score"]
                )

    return run


def _block(rows: pa.Table) -> dict:
    x = matrix(rows["vector"])
    bits = code_bits(x.shape[1])
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(x), -1)
    norm, fit = rows["norm"].to_numpy(), rows["fit"].to_numpy()
    return {
        "ids": rows["vec_id"].to_numpy(), "x": x, "partition": int(rows["partition"][0].as_py()), "turn": rotation(x.shape[1], bits),
        "signs": np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1, "scale": norm / fit / np.sqrt(bits),
        "error": CONFIDENCE * norm * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(bits - 1) + 1e-6 * norm,
    }


def _searcher(centroids: np.ndarray, k: int, exact: bool):
    def run(block: dict, queries: pa.Table) -> pa.Table:
        ids, x = block["ids"], block["x"]
        found: list[list[np.ndarray]] = [[], [], []]
        query_ids, all_q, floors = queries["vec_id"].to_numpy(), matrix(queries["vector"]), queries["floor"].to_numpy()
        for at in range(0, len(all_q), 256):
            q, own, floor = all_q[at : at + 256], query_ids[at : at + 256], floors[at : at + 256]
            size = np.linalg.norm(q, axis=1)[:, None]
            if exact:
                guess = q @ x.T
                error = 1e-9 * size * np.linalg.norm(x, axis=1)
            else:
                turned = (q / size @ block["turn"]).astype(np.float32)
                guess = (q @ centroids[block["partition"]])[:, None] + size * (turned @ block["signs"].T) * block["scale"]
                error = size * block["error"]
            other = ids != own[:, None]
            low = np.where(other, guess - error, -np.inf)
            least = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
            query, row = np.nonzero(other & (guess + error >= np.maximum(least, floor)[:, None]))
            score = (x[row] * q[query]).sum(axis=1)
            reached = score >= floor[query]  # k rows of the sample do
            query, row, score = query[reached], row[reached], score[reached]
            order = np.lexsort((ids[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            best = np.arange(len(query)) - np.searchsorted(query, query) < k
            found[0].append(own[query[best]])
            found[1].append(ids[row[best]])
            found[2].append(score[best])
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(np.concatenate(f)) for f in found))))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row of which ``is_query`` holds."""
    coded, coarse = index(vectors)
    found_schema = "query_id long, vec_id long, score double"
    if coarse is None:
        found = coded.sparkSession.createDataFrame([], found_schema)
    else:
        block_rows = max(64, BLOCK_CELLS // max(coarse.centroids.shape[1], CODE_BITS))
        blocks = np.maximum(1, -(-coarse.sizes // block_rows))
        begin = F.array(*map(F.lit, (np.cumsum(blocks) - blocks).tolist()))
        count = F.array(*map(F.lit, blocks.tolist()))
        nth = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.get(count, F.col("partition").cast("int")))
        rows = coded.withColumn("block", (F.get(begin, F.col("partition").cast("int")) + nth).cast("long"))
        queries = coded.filter(is_query).select("vec_id", "vector")
        n_queries = queries.count()
        queries = queries.repartition(max(1, -(-n_queries // 1024)))
        asks = queries.mapInArrow(_router(coarse, blocks, k, exact), "vec_id long, vector array<double>, floor double, block long")
        found = meet(rows, asks, n_queries, int(blocks.sum()), _block, _searcher(coarse.centroids, k, exact), found_schema)
        # a row found in both ways counts once, equal rows under one id as often as one way found them
        seen = queries.mapInArrow(_from_sample(coarse, k, exact), found_schema).withColumn("_way", F.lit(1))
        counts = found.withColumn("_way", F.lit(0)).unionAll(seen).groupBy("query_id", "vec_id", "score", "_way").agg(F.count("*").alias("_n"))
        most = counts.groupBy("query_id", "vec_id", "score").agg(F.max("_n").cast("int").alias("_n"))
        found = most.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), "_n"))).drop("col")
    return ranked(found, k, F.desc("score"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "score")


by_value(__name__)
