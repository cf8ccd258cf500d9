"""Hard negatives against plain Python, on made vectors of many lengths and on odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hardneg

SCHEMA = "vec_id long, label long, embedding array<double>"


def brute(rows, is_anchor, k=5):
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows]
    out = []
    for a, y, v in kept:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, z, w in kept if i != a)
        for s, i, _ in [x for x in scored if x[2] == y][:k]:
            fits = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] and -x[0] <= -s][:k]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % every == 0, F.col("label"), **options).collect()))


@pytest.mark.parametrize("cells", [hardneg.BUCKET_CELLS, 64 * 16])
def test_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(hardneg, "BUCKET_CELLS", cells)
    monkeypatch.setattr(hardneg, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(hardneg, "DIRECTORY", 3)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((4, 16))
    rows = []
    for i in range(700):
        v = (centres[i % 4] + rng.standard_normal(16) * 0.7) * float(rng.choice([0.02, 0.3, 1, 5]))
        rows.append((i, int(rng.integers(0, 3)), [float(x) for x in v]))
    # a third of another label's rows are one vector: ties over several buckets
    rows += [(1000 + i, i % 5, rows[3][2]) for i in range(350)]
    assert mined(spark, rows, 20) == brute(rows, lambda i: i % 20 == 0)


def test_pruning_keeps_all_that_reach_theta():
    rng = np.random.default_rng(7)
    vectors = np.floor(256 * rng.standard_normal((3000, 24)) * rng.choice([0.2, 1.0, 3.0], (3000, 1))).astype(np.int64)
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    bucket = hardneg.Bucket(np.arange(3000), np.zeros(3000, np.int64), vectors, lengths)
    kept = 0
    for q in range(0, 3000, 60):
        scores = vectors @ vectors[q]
        theta = float(np.partition(scores, -20)[-20])
        found = bucket.at_least(vectors[q], lengths[q], theta)
        assert set(np.flatnonzero(scores >= theta)) <= set(found)
        kept += len(found)
    assert kept < 50 * 3000 / 3


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    plain = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.9, 0.4]), (3, 2, [0.9, 0.4]), (4, 3, [0.0, 0.0])]
    odd = [
        (None, 2, [0.9, 0.4]), (5, None, [0.9, 0.4]), (6, 2, None), (7, 2, []), (8, 2, [0.9, None]), (9, 2, [nan, 0.4]),
        (11, 2, [inf, 0.4]), (12, 2, [1e300, 0.4]), (13, 2, [0.9, 0.4, 0.1]), (14, 1, [1e7, 0.0]),
    ]
    expected = brute(plain, lambda i: i % 10 == 0)
    assert expected and mined(spark, plain + odd, 10) == expected
    # repeated rows count each, an anchor's own id is no other row
    assert mined(spark, plain + plain, 10) == sorted(brute(plain + plain, lambda i: i % 10 == 0))
    assert mined(spark, [(0, 1, [0.0, 0.0]), (1, 1, [1.0, 1.0]), (2, 2, [3.0, 1.0])], 10) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0])], 10) == []
    assert mined(spark, [], 10) == []
    clash = spark.createDataFrame(plain, SCHEMA).selectExpr("*", "1 as bucket", "'x' as number", "2 as theta", "0 as wanted")
    got = hardneg.mine(clash, F.col("vec_id") % 10 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == expected


def test_large_whole_numbers_stay_exact(spark):
    rows = [(0, 1, [2.0**20, 1 / 256]), (1, 1, [2.0**20, 3 / 256]), (2, 2, [2.0**20, 2 / 256]), (3, 2, [2.0**20, 4 / 256])]
    assert mined(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_only_reaching_buckets_are_visited():
    last = hardneg._last_bucket(np.array([8.0, 4.0, 2.0, 1.0]), 2, 7)
    pd = pytest.importorskip("pandas")
    got = last.func(pd.Series([1.0, 1.0, 1.0, 1.0, 1.0]), pd.Series([0.0, 9.0, 8.0, 3.0, 0.5]))
    assert got.tolist() == [6, -1, 1, 3, 6]
