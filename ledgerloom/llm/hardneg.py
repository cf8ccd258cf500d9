"""Hard-negative mining by coordinate pruning within length buckets.

Vectors are scaled to integers, so every score is exact. All rows are numbered by descending length and cut into
buckets of equal size; a bucket's lists hold, for each coordinate, its rows in the order of their normalised values.

*One search.* An anchor and a least score theta visit the buckets whose longest vector can reach theta (rows are numbered by
length, so these are the first ones). In a bucket, cos(angle) must be at least t = theta / (|anchor| * longest). For a
focus coordinate, one of the anchor's largest, with value cos(a) that allows only values from cos(a + acos t) to cos(a - acos t):
a stretch of the sorted list. The shortest stretch is taken and rows outside of the other stretches go. What is left is
bounded by its partial product over the focus coordinates plus the product of the remaining lengths, and then
verified with the whole integer product.

*Three passes.* (1) Within its own bucket an anchor gets a lower bound of its k-th best score among its label. (2) With that
theta it searches all rows of its label: its positives. (3) With the least score that any of its positives admits it searches
the rows of other labels; each positive keeps its best few in its own range. Every bucket gives an anchor at most a few
rows, whatever ties it holds, and the few of all buckets are ranked at the end.

A row is shuffled once for each pass (once for ``QUERIES_AT_ONCE`` anchors), and sent to its bucket's task in front of the anchors,
which are streamed past it. So a task holds one bucket, however many anchors or equal vectors there are. What
the driver sees is the longest vector of at most ``DIRECTORY`` groups of buckets.

Defined results: rows with a null id or label, or a vector that is null, empty or holds null or non-finite components take no
part; nor do vectors whose scaled squared length is 2**60 or more, as a long could not hold what is compared; of several
dimensions in a table, the one most rows have (the larger on a tie) is searched. Zero vectors take part. An anchor's own id is
no other row; rows repeated under one id are anchors and results as often as they are there; ties go to the smaller
id. A positive of negative score admits nothing, as no score is both over 0.8 of it and under it. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_value
from ledgerloom.operators.running import number_by_range
from ledgerloom.session import cut

SCALE = 256
BUCKET_CELLS = 1 << 17
QUERIES_AT_ONCE = 32_768
DIRECTORY = 4_096
FOCUS = 12
_SLACK = 1e-9
_SQUARED = float(1 << 60)

_ASKS = "bucket long, part long, asks boolean, number long, vec_id long, label long, vector array<long>, length double, theta double, wanted array<long>"


class Bucket:
    """Rows of one length bucket with their sorted coordinate lists (one for each coordinate, in one piece of memory)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.vectors, self.lengths = ids, labels, vectors, lengths
        self.longest = float(lengths.max(initial=0.0))
        self.unit = np.ascontiguousarray((vectors / np.where(lengths > 0, lengths, 1.0)[:, None]).T)
        self.order = np.argsort(self.unit, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=1)
        # among rows of about one length, partial products rule none out where no single coordinate does
        self.alike = bool(lengths.min(initial=np.inf) > 0.8 * self.longest)
        # partial sums of a product stay under the product of the lengths, so doubles hold them exactly
        self.doubles = vectors.astype(float) if self.longest**2 < 2.0**52 else None

    def at_least(self, query: np.ndarray, length: float, theta: float) -> np.ndarray:
        """Rows that may score ``theta`` or more with the query."""
        everything = np.arange(len(self.ids))
        if theta <= 0 or not length:
            return everything
        least = theta * (1 - _SLACK) / length
        if least > self.longest * (1 + _SLACK):
            return everything[:0]
        unit = query / length
        focus = np.argpartition(-np.abs(unit), FOCUS)[:FOCUS] if len(unit) > FOCUS else np.arange(len(unit))
        angle, wide = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(1.0, least / self.longest))
        low = np.cos(np.minimum(np.pi, angle + wide)) - _SLACK
        high = np.cos(np.maximum(0.0, angle - wide)) + _SLACK
        begin = np.array([self.sorted[f].searchsorted(x) for f, x in zip(focus, low)])
        end = np.array([self.sorted[f].searchsorted(x, "right") for f, x in zip(focus, high)])
        telling = np.flatnonzero(end - begin < len(everything))
        if not len(telling) and self.alike:
            return everything
        rows, seen = everything, self.unit[focus]
        if len(telling):
            first = telling[(end - begin)[telling].argmin()]
            rows = self.order[focus[first], begin[first] : end[first]]
            for i in telling:
                if i != first:
                    value = seen[i, rows]
                    rows = rows[(value >= low[i]) & (value <= high[i])]
            seen = seen[:, rows]
        rest = np.sqrt(np.maximum(1 - (seen * seen).sum(axis=0), 0) * max(1 - float((unit[focus] ** 2).sum()), 0.0))
        bound = (unit[focus] @ seen + rest + _SLACK) * self.lengths[rows]
        return rows[bound >= least]

    def scores(self, rows: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
        if self.doubles is not None and (length * self.longest) < 2.0**52:
            q = query.astype(float)
            found = (self.doubles @ q)[rows] if 4 * len(rows) > len(self.ids) else self.doubles[rows] @ q
            return found.astype(np.int64)
        return (self.vectors[rows] * query).sum(axis=1)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the first ``k``: higher scores, then smaller ids."""
        if len(rows) > 4 * k:
            keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            return keep[np.lexsort((self.ids[rows[keep]], -scores[keep]))[:k]]
        return np.lexsort((self.ids[rows], -scores))[:k]


def scaled(vectors: DataFrame, label: Column, name: str = "embedding") -> DataFrame:
    """vec_id, label, integer vector and length of the rows that take part."""
    limit = float("inf")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(name).cast("array<double>").alias("vector")
    )
    fine = rows.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    )
    # beyond the range of a long this gives its largest value, whose square is over the limit below
    whole = F.transform("vector", lambda x: F.floor(x * SCALE))
    squared = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    scaled_rows = fine.select("vec_id", "label", whole.alias("vector")).withColumn("_squared", squared).filter(F.col("_squared") < _SQUARED)
    return scaled_rows.select("vec_id", "label", "vector", F.sqrt("_squared").alias("length"))


def _stream(search: Callable[[Bucket, dict], Iterable[tuple]], schema: pa.Schema):
    """Runs ``search`` for every asking row of a (bucket, part), whose rows come first."""

    def matrix(columns: pa.Array) -> np.ndarray:
        return columns.flatten().to_numpy(zero_copy_only=False).reshape(len(columns), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, held, bucket = None, [], None
        for batch in batches:
            names = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = np.stack([names[n].to_numpy(zero_copy_only=False) for n in ("bucket", "part", "asks")], axis=1).astype(np.int64)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)]):
                if a == b:
                    continue
                part = {n: c.slice(a, b - a) for n, c in names.items()}
                if (place := tuple(keys[a][:2])) != key:
                    key, held, bucket = place, [], None
                numbers = {n: part[n].to_numpy(zero_copy_only=False) for n in ("number", "vec_id", "label", "length")}
                vectors = matrix(part["vector"])
                if not keys[a][2]:
                    held.append((numbers["vec_id"], numbers["label"], vectors, numbers["length"]))
                    continue
                if bucket is None:
                    if not held:
                        continue
                    bucket, held = Bucket(*map(np.concatenate, zip(*held))), []
                out: list[tuple] = []
                theta, wanted = part["theta"].to_numpy(zero_copy_only=False), part["wanted"].to_pylist()
                for i in range(len(vectors)):
                    ask = {n: v[i] for n, v in numbers.items()}
                    out.extend(search(bucket, {**ask, "vector": vectors[i], "theta": theta[i], "wanted": wanted[i]}))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _meet(rows: DataFrame, asks: DataFrame, n_asks: int, tasks: int, run: Callable, schema: str) -> DataFrame:
    """Streams the anchors' ``asks`` (bucket, row columns, theta, wanted) past the rows of their buckets."""
    parts = max(1, -(-n_asks // QUERIES_AT_ONCE))
    none = F.lit(None)
    held = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).withColumns(
        {"asks": F.lit(False), "number": F.lit(0).cast("long"), "theta": F.lit(0.0), "wanted": none.cast("array<long>")}
    )
    asking = asks.withColumns({"asks": F.lit(True), "part": F.pmod("number", F.lit(parts)).cast("long")})
    names = [c.split()[0] for c in _ASKS.split(", ")]
    both = held.select(*names).unionAll(asking.select(*names))
    dealt = both.repartition(tasks * parts, "bucket", "part").sortWithinPartitions("bucket", "part", "asks")
    return dealt.mapInArrow(run, schema)


_FOUND = pa.schema([("number", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_MINED = pa.schema([("number", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _same_label(k: int):
    def search(bucket: Bucket, ask: dict) -> Iterable[tuple]:
        rows = bucket.at_least(ask["vector"], ask["length"], ask["theta"])
        rows = rows[(bucket.labels[rows] == ask["label"]) & (bucket.ids[rows] != ask["vec_id"])]
        scores = bucket.scores(rows, ask["vector"], ask["length"])
        return [(ask["number"], bucket.ids[rows[i]], scores[i]) for i in bucket.best(rows, scores, k)]

    return search


def _other_labels(k: int):
    def search(bucket: Bucket, ask: dict) -> Iterable[tuple]:
        rows = bucket.at_least(ask["vector"], ask["length"], ask["theta"])
        rows = rows[bucket.labels[rows] != ask["label"]]
        scores = bucket.scores(rows, ask["vector"], ask["length"])
        out = []
        for place, positive in enumerate(ask["wanted"]):
            fits = np.flatnonzero((5 * scores >= 4 * positive) & (scores <= positive))
            best = fits[bucket.best(rows[fits], scores[fits], k)]
            out.extend((ask["number"], place, bucket.ids[rows[i]], scores[i]) for i in best)
        return out

    return search


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows of which ``is_anchor`` holds. Its positives are the first ``positives`` other rows of its label. For each of
    them, the first ``negatives`` rows of other labels that score from 0.8 of the positive's score up to it.
    """
    rows = scaled(vectors, label)
    common = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, total = (common["dim"], common["n"]) if common else (1, 0)
    rows = rows.filter(F.size("vector") == dim)
    n_buckets = max(1, -(-total // max(64, BUCKET_CELLS // dim)))
    size = max(1, -(-total // n_buckets))
    numbered = number_by_range(rows, [F.desc("length"), F.col("vec_id"), F.xxhash64("vector"), F.col("label")], "number")
    rows = cut(numbered.withColumn("bucket", F.expr(f"(number - 1) div {size}")))
    tasks = min(2 * n_buckets, 20_000)

    wide = -(-n_buckets // DIRECTORY)
    longest = rows.groupBy(F.expr(f"bucket div {wide}").alias("group")).agg(F.max("length").alias("longest")).orderBy("group").collect()
    reach = np.array([r["longest"] for r in longest])
    anchors = cut(rows.filter(is_anchor))
    n_anchors = anchors.count()
    columns = ["number", "vec_id", "label", "vector", "length", "bucket"]

    last_bucket = _last_bucket(reach, wide, n_buckets)

    def visits(asks: DataFrame) -> DataFrame:
        """The asks, once for each bucket that can hold a row scoring theta."""
        reaching = asks.withColumn("last", last_bucket("length", "theta")).filter("last >= 0")
        return reaching.withColumn("bucket", F.explode(F.expr("sequence(0L, last)")))

    found = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in _FOUND)
    # pass 1: the own bucket gives a lower bound
    own = anchors.select(*columns).withColumns({"theta": F.lit(0.0), "wanted": F.lit(None).cast("array<long>")})
    seeds = _meet(rows, own, n_anchors, tasks, _stream(_same_label(positives), _FOUND), found)
    floors = seeds.groupBy("number").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == positives)
    asks = anchors.join(floors, "number", "left").select(
        *columns, F.greatest(F.coalesce(F.col("floor").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("theta"), F.lit(None).cast("array<long>").alias("wanted")
    )
    # pass 2: positives
    by = Window.partitionBy("number").orderBy(F.desc("score"), F.asc("vec_id"))
    near = _meet(rows, visits(asks), n_anchors, tasks, _stream(_same_label(positives), _FOUND), found)
    near = near.withColumn("place", F.row_number().over(by) - 1).filter(F.col("place") < positives)
    near = cut(near.select("number", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # pass 3: negatives
    wanted = near.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("w"), F.min(F.when(F.col("positive_score") >= 0, F.col("positive_score"))).alias("least"))
    asks = anchors.join(wanted.filter("least is not null"), "number").select(
        *columns, (F.col("least") * F.lit(0.8)).cast("double").alias("theta"), F.transform("w", lambda x: x["positive_score"]).alias("wanted")
    )
    hard = _meet(rows, visits(asks), n_anchors, tasks, _stream(_other_labels(negatives), _MINED), "number long, place int, vec_id long, score long")
    by = Window.partitionBy("number", "place").orderBy(F.desc("score"), F.asc("vec_id"))
    hard = hard.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
    named = anchors.select("number", F.col("vec_id").alias("anchor_id"))
    return hard.join(near, ["number", "place"]).join(named, "number").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _last_bucket(reach: np.ndarray, wide: int, n_buckets: int):
    """The last bucket whose longest vector can score theta with a query of that length, -1 if none can."""

    @F.pandas_udf("long")
    def last(length: pd.Series, theta: pd.Series) -> pd.Series:
        least = np.where(theta > 0, theta * (1 - _SLACK) / np.maximum(length, 1e-300), 0.0)
        groups = np.searchsorted(-reach, -least, "right")  # lengths descend
        return pd.Series(np.minimum(groups * wide, n_buckets) - 1)

    return last


by_value(__name__)
