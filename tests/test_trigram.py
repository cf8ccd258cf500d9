"""Searches with the trigram index against the scans, and what they read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import any_contains, raw_like
from ledgerloom.operators import trigram

COLUMNS = ["name", "code"]


def made(spark, n=400):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abAB é%_\\山\n") for _ in range(rnd.randrange(0, 9)))
    rows = [(i, rnd.choice([None, word(), word() + "common" + word()]), rnd.choice([None, f"C{i:05d}", ""])) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, name string, code string")


@pytest.fixture(scope="module")
def df(spark):
    return made(spark).persist()


@pytest.fixture(scope="module")
def index(spark, df, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "v")
    trigram.write_index(df, COLUMNS, path)
    return trigram.read_index(spark, path)


def ids(rows):
    return sorted(r.id for r in rows.select("id").collect())


@pytest.mark.parametrize("looked_up", [0, 1000])
@pytest.mark.parametrize("text", ["", "ab", "COM", "common", "aba", "C0012", "c00", "zzz", "é%_", "b\n", "mon山"])
def test_contains(df, index, monkeypatch, text, looked_up):
    monkeypatch.setattr(trigram, "LOOKED_UP", looked_up)
    assert ids(trigram.contains(df, index, text, *COLUMNS)) == ids(df.filter(any_contains(text, *COLUMNS)))


@pytest.mark.parametrize("pattern", ["%common%", "%ommo_%", "C001%", "_00%12", "%", "ab", "%COM%ab%", "\\%", "%mon_%", "C00012"])
def test_like(df, index, pattern):
    got = trigram.like(df, index, {"name": pattern, "code": "%0001_"})
    assert ids(got) == ids(df.filter(raw_like(F.col("name"), pattern) | raw_like(F.col("code"), "%0001_")))


@pytest.mark.parametrize("texts", [{"name": "common", "code": "C001"}, {"name": "", "code": "0123"}, {"name": "a", "code": ""}])
def test_contains_all(df, index, texts):
    want = df.filter(any_contains(texts["name"], "name") & any_contains(texts["code"], "code"))
    assert ids(trigram.contains_all(df, index, texts)) == ids(want)


def test_changed_rows(spark, df, index):
    """New rows' trigrams are added; what a changed row no longer holds is found out by the test of the row."""
    new = spark.createDataFrame([(5, "fresh common text", "C9"), (1000, "freshest", None)], df.schema)
    table = df.filter("id <> 5 and id <> 7").unionByName(new)
    grown = trigram.with_rows(index, new, COLUMNS)
    for text in ("fresh", "common", "c00007", "C00005"):
        assert ids(trigram.contains(table, grown, text, *COLUMNS)) == ids(table.filter(any_contains(text, *COLUMNS)))


def test_fewer_rows_are_read(spark, tmp_path):
    from tests.test_clustered import read_files

    n = 40_000
    rows = spark.range(n).selectExpr("id", "concat('customer', id) as name", "'x' as code")
    rows.repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "customer"))
    stored = spark.read.parquet(str(tmp_path / "customer"))
    trigram.write_index(stored, COLUMNS, str(tmp_path / "index"))
    index = trigram.read_index(spark, str(tmp_path / "index"))
    found = trigram.contains(stored, index, "r39875", *COLUMNS)
    assert [r.id for r in found.collect()] == [39875]
    assert read_files(found)["customer"][1] <= n / 3
    assert trigram.contains(stored, index, "nowhere", *COLUMNS).count() == 0


def test_long_lists_are_neither_held_by_a_task_nor_merged_into_few_parts(spark, tmp_path, monkeypatch):
    """Lists are joined, not counted by id; the parts of a written index follow the number of texts; a repeated posting counts once."""
    monkeypatch.setattr(trigram, "PART_ROWS", 100)
    df = spark.range(500).selectExpr("id", "concat('so', id) as code")
    trigram.write_index(df, ["code"], str(tmp_path / "index"))
    index = trigram.read_index(spark, str(tmp_path / "index"))
    assert len(index.postings.inputFiles()) >= 4
    plan = trigram.candidates(index, "code", ["so12"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    twice = trigram.with_rows(index, df.filter("id < 130"), ["code"])
    for i in (index, twice):
        assert sorted(r.id for r in trigram.contains(df, i, "SO12", "code").collect()) == [12, *range(120, 130)]
