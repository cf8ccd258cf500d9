"""Admission against one-by-one replay, with both ways of deciding forced."""

import random

import pytest

from ledgerloom.operators.admission import admit_in_order

CLAIMS = "seq bigint, place bigint, item bigint, need bigint, delta bigint, eligible boolean"


def by_hand(claims, capacity):
    left, out = dict(capacity), {}
    for seq in sorted({c[0] for c in claims}):
        mine = [c for c in claims if c[0] == seq]
        have = {(c[1], c[2]): left.get((c[1], c[2]), 0) for c in mine}
        ok = all(c[5] and (c[3] is None or c[3] <= have[c[1], c[2]]) for c in mine)
        for c in mine:
            out[c[0], c[1], c[2]] = (ok, have[c[1], c[2]])
            if ok:
                left[c[1], c[2]] = left.get((c[1], c[2]), 0) - c[4]
    return out


def run(spark, claims, capacity, **options):
    df = spark.createDataFrame(claims, CLAIMS)
    cap = spark.createDataFrame([(p, i, c) for (p, i), c in capacity.items()], "place bigint, item bigint, capacity bigint")
    rows = admit_in_order(df, ["place", "item"], cap, ["place"], **options).collect()
    assert len(rows) == len(claims)
    return {(r.seq, r.place, r.item): (r.accepted, r.available) for r in rows}


def random_case(seed, requests=120):
    rnd = random.Random(seed)
    claims = []
    for seq in range(requests):
        place = 0 if rnd.random() < 0.5 else rnd.randrange(1, 4)  # one place holds half of all
        eligible = rnd.random() < 0.95
        for item in rnd.sample(range(5), rnd.randrange(1, 4)):
            need = rnd.choice([None, 1, 2, 3, 5, 8])
            delta = rnd.choice([-2, 0, 1, 3]) if need is None else need * rnd.choice([1, 1, 1, 0])
            claims.append((seq, place, item, need, delta, eligible))
    capacity = {(p, i): rnd.randrange(-2, 40) for p in range(4) for i in range(4)}
    return claims, capacity


@pytest.mark.parametrize("seed, replay_rows", [(1, 0), (1, 60), (1, 10_000), (2, 30), (3, 60), (4, 90), (5, 120)])
def test_equals_sequential(spark, seed, replay_rows):
    claims, capacity = random_case(seed)
    assert run(spark, claims, capacity, replay_rows=replay_rows) == by_hand(claims, capacity)


def test_refused_request_gives_back(spark):
    # The second request fails on item 1, so its 5 of item 0 stay for the third.
    claims = [
        (1, 0, 0, 5, 5, True),
        (2, 0, 0, 5, 5, True), (2, 0, 1, 1, 1, True),
        (3, 0, 0, 5, 5, True),
    ]
    for rows in (0, 100):
        got = run(spark, claims, {(0, 0): 10}, replay_rows=rows)
        assert [got[s, 0, 0][0] for s in (1, 2, 3)] == [True, False, True]


def test_blocks_of_seq(spark):
    # Sequence numbers far apart fall into different blocks of the running sums.
    claims = [(s << 21, 0, 0, 3, 3, True) for s in range(8)]
    got = run(spark, claims, {(0, 0): 14}, replay_rows=0)
    assert [got[s << 21, 0, 0][0] for s in range(8)] == [True] * 4 + [False] * 4


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    """Each request wants what the one before may have taken, so narrowing decides one at a time."""
    from ledgerloom.operators import admission

    rounds = []
    real = admission._bounding_round
    monkeypatch.setattr(admission, "_bounding_round", lambda *a: rounds.append(1) or real(*a))
    claims = []
    for seq in range(2000):
        claims.append((seq, 0, seq, 1, 1, True))
        claims.append((seq, 0, seq + 1, 1, 1, True))
    capacity = {(0, i): 1 for i in range(2001)}
    assert run(spark, claims, capacity, replay_rows=0) == by_hand(claims, capacity)
    assert len(rounds) <= 5


def test_a_claim_without_delta_is_refused(spark):
    claims = [(1, 0, 0, 1, None, True), (2, 0, 0, 1, 1, True)]
    for rows in (0, 100):
        got = run(spark, claims, {(0, 0): 1}, replay_rows=rows)
        assert not got[1, 0, 0][0] and got[2, 0, 0][0]


@pytest.mark.parametrize("replay_rows", [0, 100])
def test_only_listed_resources_take(spark, replay_rows):
    # item 1 has no capacity: what is given back there stays without effect where only listed resources count
    claims = [(1, 0, 1, None, -5, True), (2, 0, 1, 3, 3, True), (3, 0, 0, 3, 3, True), (4, 0, 0, 3, 3, True)]
    capacity = spark.createDataFrame([(0, 0, 5), (0, None, 9), (7, 0, 9)], "place bigint, item bigint, capacity bigint")
    for flag, wanted in ((True, [True, False, True, False]), (False, [True, True, True, False])):
        df = spark.createDataFrame([(*c, flag) for c in claims], CLAIMS + ", only_listed boolean")
        rows = admit_in_order(df, ["place", "item"], capacity, ["place"], replay_rows=replay_rows).collect()
        assert [r.accepted for r in sorted(rows)] == wanted


def test_capacity_is_not_joined_to_claims(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, 5, True)], CLAIMS)
    capacity = spark.createDataFrame([(0, 0, 5)], "place bigint, item bigint, capacity bigint")
    judged = admit_in_order(df, ["place", "item"], capacity, ["place"])
    assert "Join" not in judged._jdf.queryExecution().optimizedPlan().toString()
