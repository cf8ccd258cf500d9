"""Claims of unique values against deciding them one by one."""

from __future__ import annotations

import random

import pytest

from ledgerloom.operators import ownership
from ledgerloom.plans import changes
from tests.ledger import by, ledger


def one_by_one(claims, stored):
    held, out = dict(stored), {}
    for seq, row, value in sorted(claims):
        out[seq] = not any(v == value and r != row for r, v in held.items())
        if out[seq]:
            held[row] = value
    return out


def decided(spark, claims, stored):
    got = ownership.grant_in_order(
        spark.createDataFrame(claims, "seq bigint, row bigint, value string"), spark.createDataFrame(stored, "row bigint, value string")
    ).collect()
    assert len(got) == len(claims)
    return {r.seq: r.granted for r in got}


@pytest.mark.parametrize("least", [0.0, 0.1, 1.1], ids=["rounds", "both", "replay"])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_claims(spark, monkeypatch, least, seed):
    """Few rows and values, so values go to and fro; some stored values belong to two rows."""
    monkeypatch.setattr(ownership, "LEAST_DECIDED", least)
    rnd = random.Random(seed)
    stored = [(r, f"v{r % 7}") for r in range(9)] + [(20 + r, f"u{r}") for r in range(5)]
    values = [f"v{i}" for i in range(8)] + [f"u{i}" for i in range(6)] + ["new"]
    claims = [(i, rnd.choice([rnd.randrange(9), 20 + rnd.randrange(5), -i - 1]), rnd.choice(values)) for i in range(60)]
    expected = one_by_one(claims, stored)
    assert decided(spark, claims, stored) == expected
    assert 5 < sum(expected.values()) < 55


def test_hot_value_and_a_long_chain(spark):
    """A third of all claims ask for one value; each of the others takes what the row before it has just given up."""
    claims = [(3 * i, -i - 1, "hot") for i in range(200)]
    claims += [(3 * i + 1, i, f"c{i + 1}") for i in reversed(range(200))]
    stored = [(i, f"c{i}") for i in range(200)]
    assert decided(spark, claims, stored) == one_by_one(claims, stored)


def test_nothing_contested_needs_no_round(spark, monkeypatch):
    monkeypatch.setattr(ownership, "_round", None)
    assert decided(spark, [(1, 1, "b"), (2, 2, "c"), (3, 1, "a")], [(1, "a"), (9, "z")]) == {1: True, 2: True, 3: True}
    assert decided(spark, [], [(1, "a")]) == {}


def test_codes_given_up_may_be_taken(spark):
    t = ledger(spark)
    schema = "seq bigint, id bigint, code string, supplier bigint, date date, keeper_id bigint, staff1_id bigint, hidden boolean, note string"
    head = t["instream"].filter("id = 1").first()
    change = lambda seq, id_, code: (seq, id_, code, 1, head.date, 1, 1, False, None)
    batch = [
        change(1, 1, "FRESH1"), change(2, 3, "IN01"), change(3, None, "IN03"), change(4, 1, "IN01"), change(5, None, "IN03"),
        change(6, 3, "!"), change(7, None, "FRESH1"), change(8, 1, "LAST1"), change(9, None, "FRESH1"),
    ]
    got = changes.upsert_headers(t, "instream", spark.createDataFrame(batch, schema))
    refused = {r.seq: r.reason for r in got.rejected.collect()}
    assert refused == {4: "duplicate_code", 5: "duplicate_code", 6: "code", 7: "duplicate_code"}
    codes = {i: r.code for i, r in by(got.tables["instream"], "id").items()}
    assert codes[1] == "LAST1" and codes[3] == "IN01" and sorted(codes.values()).count("IN03") == 1 and "FRESH1" in codes.values()


def test_contested_values_are_found_in_one_grouping(spark):
    claims = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "seq bigint, row bigint, value string")
    stored = spark.createDataFrame([(1, "a"), (3, "c")], "row bigint, value string")
    spark.sparkContext.setJobGroup("contested", "")
    try:
        granted = ownership.grant_in_order(claims, stored)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("contested")) <= 5
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in granted.collect()) == [(1, True), (2, True)]
