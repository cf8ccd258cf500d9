"""Versions of a store: which files a commit writes, and that old versions stay."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import changes
from ledgerloom.sources import snapshots
from ledgerloom.sources.snapshots import Delta
from tests.ledger import AS_OF, by, ledger


def rows(df):
    return sorted(map(repr, df.collect()))


def files(spark, root, table, version):
    listed = snapshots.manifest(spark, root, version).filter(F.col("table") == table).collect()
    return {r.file: (r.n, r.low, r.high) for r in listed}


@pytest.fixture(scope="module")
def many_lines(spark):
    """The hand-made ledger with 40 more receipt lines."""
    t = ledger(spark)
    more = spark.range(100, 140).selectExpr(
        "id", "1L as inid_id", "id % 3 + 1 as product_id", "cast(2 as decimal(8,2)) as value", "5 as quantity",
        "id % 2 + 1 as depot_id", "cast(null as string) as depotdetail",
    )
    return t.replaced(indetail=t["indetail"].unionByName(more))


def test_a_small_edit_writes_only_the_files_that_held_its_lines(spark, many_lines, tmp_path):
    root = str(tmp_path / "store")
    assert snapshots.write_store({n: many_lines[n] for n in ("indetail", "instream", "outdetail", "outstream", "products", "depot")}, root, file_rows=10) == 1
    before = files(spark, root, "indetail", 1)
    assert len(before) >= 4 and sum(n for n, _, _ in before.values()) == 47
    t = snapshots.read_snapshot(spark, root)
    batch = spark.createDataFrame([(1, 105, "9.00", "50", 1, "x")], "seq bigint, id bigint, value string, quantity string, depot_id bigint, depotdetail string")
    got = changes.edit_receipt_lines(t, batch, as_of=AS_OF)
    assert snapshots.commit(spark, root, got.delta, file_rows=10) == 2
    after = files(spark, root, "indetail", 2)
    gone = set(before) - set(after)
    assert len(gone) == 1 and before[gone.pop()][1] <= 105 and len(set(after) - set(before)) == 1
    assert files(spark, root, "outdetail", 1) == files(spark, root, "outdetail", 2)
    new = snapshots.read_snapshot(spark, root)
    assert rows(new["indetail"]) == rows(got.tables["indetail"]) and by(new["indetail"], "id")[105].quantity == 50
    assert rows(snapshots.read_snapshot(spark, root, 1)["indetail"]) == rows(many_lines["indetail"])


def test_commits_add_change_and_delete(spark, tmp_path):
    root = str(tmp_path / "store")
    base = spark.range(50).selectExpr("id", "concat('shop', id) as name")
    snapshots.write_store({"shop": base, "depot": ledger(spark)["depot"]}, root, file_rows=10)
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "id bigint")
    named = lambda *n: ids(*n).selectExpr("id", "concat('new', id) as name")
    # 7 is deleted and given again, 999 is not there, 60 and 61 are new
    assert snapshots.commit(spark, root, {"shop": Delta(named(7, 9, 60, 61), ids(7, 8, 999))}) == 2
    assert snapshots.commit(spark, root, {"shop": Delta(deleted=ids(*range(50)))}) == 3
    assert snapshots.commit(spark, root, {}) == 4
    names = lambda v: {r.id: r.name for r in snapshots.read_snapshot(spark, root, v)["shop"].collect()}
    expected = {i: f"shop{i}" for i in range(50) if i != 8} | {i: f"new{i}" for i in (7, 9, 60, 61)}
    assert names(2) == expected and names(1) == {i: f"shop{i}" for i in range(50)}
    assert names(3) == names(4) == {60: "new60", 61: "new61"}
    assert rows(snapshots.read_snapshot(spark, root)["depot"]) == rows(snapshots.read_snapshot(spark, root, 1)["depot"])
    assert snapshots.read_snapshot(spark, root)["products"].count() == 0
    # a version can be written once, and a version without its end marker is not there
    with pytest.raises(Exception, match="already exists"):
        snapshots.commit(spark, root, {"shop": Delta(named(1))}, base=1)
    (tmp_path / "store" / "versions" / "v5").mkdir()
    assert snapshots.versions(spark, root) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        snapshots.write_store({"shop": base}, root)


def applied(table, delta):
    out = table
    for ids in (delta.rows, delta.deleted):
        if ids is not None:
            out = out.join(ids.select("id"), "id", "left_anti").select(*table.columns)
    return out if delta.rows is None else out.unionByName(delta.rows)


def docs(spark, texts):
    from ledgerloom.sources import documents

    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts, 1)], "seq bigint, value string")
    return documents.parse_orders(df, "value", "seq")


ORDER = '{"id":"%s","hidden":"%s","code":"SO99","customer":"1","discount":"0","note":"n","date":"2012-06-30 10:00:00","orderDetail":[%s]}'
LINE = '{"id":"%s","product":"1","price":"3.00","quantity":"1"}'


def jobs(spark, t):
    """Every change job with a batch of which some is accepted."""
    frame = spark.createDataFrame
    receipt = "seq bigint, id bigint, value string, quantity string, depot_id bigint, depotdetail string"
    head = "seq bigint, id bigint, code string, {}, date {}, keeper_id bigint, staff1_id bigint, hidden boolean, note string"
    nodes = frame([(0, 1, "Home2", None), (1, 2, "Bed", 1), (2, 900, "New", 2)], "ordinal int, id bigint, name string, pId bigint")
    new_orders = docs(spark, [ORDER % ("", "", LINE % "")]).selectExpr("*", "2L as shop_id", "1L as staff_id", "timestamp_ntz'2012-06-30 09:00:00' as moment")
    yield changes.soft_delete(t, "outstream", frame([(1,), (77,)], "id bigint"))
    yield changes.upsert_headers(t, "instream", frame([(1, 2, "IN77", 1, date(2012, 1, 5), 1, 1, False, None), (2, None, "IN78", 2, date(2012, 1, 6), 1, 1, False, None)], head.format("supplier bigint", "date")))
    yield changes.add_receipt_lines(t, frame([(1, 1, 1, 1, "2.00", "4", "a")], "seq bigint, inid_id bigint, product_id bigint, depot_id bigint, value string, quantity string, depotdetail string"))
    yield changes.delete_receipt_lines(t, frame([(1, 2), (2, 7), (3, 1)], "seq bigint, id bigint"), as_of=AS_OF)
    yield changes.edit_receipt_lines(t, frame([(1, 1, "9.00", "11", 2, "x"), (2, 7, "1.00", "2", 1, "")], receipt), as_of=AS_OF)
    yield changes.copy_receipt_to_issue(t, frame([(4, 1)], "outid_id bigint, inid_id bigint"))
    yield changes.add_issue_lines(t, frame([(1, 1, 2, 2, "1")], "seq bigint, outid_id bigint, product_id bigint, depot_id bigint, quantity string"))
    yield changes.edit_issue_lines(t, frame([(1, 1, 2, "5"), (2, 7, 1, "2")], "seq bigint, id bigint, depot_id bigint, quantity string"), as_of=AS_OF)
    yield changes.delete_issue_lines(t, frame([(1, 1), (2, 4)], "seq bigint, id bigint"), as_of=AS_OF)
    yield changes.apply_new_orders(t, new_orders)
    stored = t["sellorderdetail"].filter("oid_id = 1").first()
    yield changes.apply_order_edits(t, docs(spark, [ORDER % ("1", "0", ",".join([LINE % stored.id, LINE % ""])), ORDER % ("4", "1", "")]), as_of=AS_OF)
    yield changes.apply_category_tree(t, nodes)


def test_every_job_tells_what_it_changed(spark):
    t = ledger(spark)
    changed = set()
    for got in jobs(spark, t):
        assert got.delta
        for table in t:
            if table in got.delta:
                assert rows(applied(t[table], got.delta[table])) == rows(got.tables[table]), table
                if rows(got.tables[table]) != rows(t[table]):
                    changed.add(table)
            else:
                assert got.tables[table] is t[table] or rows(got.tables[table]) == rows(t[table])
    assert changed >= {"outstream", "instream", "indetail", "outdetail", "sellorder", "sellorderdetail", "category", "products"}


def test_newest_rows_and_deep_pages(spark, tmp_path):
    """Overlapping files form a group; only the groups that hold the rows are read."""
    from ledgerloom.sources import newest

    root = str(tmp_path / "store")
    shops = lambda df: df.selectExpr("id", "concat('s', id % 7) as name")
    snapshots.write_store({"shop": shops(spark.range(0, 1000, 2)), "depot": ledger(spark)["depot"].limit(0)}, root, file_rows=50)
    # odd ids below 200 lie between the others: their files overlap
    snapshots.commit(spark, root, {"shop": Delta(shops(spark.range(1, 200, 2)).unionByName(shops(spark.range(2000, 2010))))}, file_rows=50)
    ids = sorted([*range(0, 1000, 2), *range(1, 200, 2), *range(2000, 2010)], reverse=True)
    groups = newest.directory(spark, root, "shop")
    assert sum(g.n for g in groups) == len(ids) and any(len(g.files) > 1 for g in groups) and len(groups) > 6
    got = lambda df: [r.id for r in df.collect()]
    for k in (1, 10, 11, 120, 5000):
        assert got(newest.newest(spark, root, "shop", k)) == ids[:k]
    of_name = [i for i in ids if i % 7 == 3]
    for k in (2, 60, 5000):
        assert got(newest.newest(spark, root, "shop", k, F.col("name") == "s3")) == of_name[:k]
    for n in (1, 2, 15, len(ids) // 20 + 1, 400):
        assert got(newest.page(spark, root, "shop", n)) == ids[(n - 1) * 20 : n * 20]
    assert newest.page_total(spark, root, "shop") == -(-len(ids) // 20)
    deep = newest.page(spark, root, "shop", 15)
    assert len(deep.inputFiles()) <= 2 and len(newest.newest(spark, root, "shop", 10).inputFiles()) == 1
    assert got(newest.newest(spark, root, "depot", 5)) == got(newest.page(spark, root, "depot", 1)) == []
    assert newest.page_total(spark, root, "depot") == 0 and got(newest.newest(spark, root, "shop", 3, version=1)) == [998, 996, 994]


def test_a_table_has_a_bounded_number_of_small_files(spark, tmp_path, monkeypatch):
    """However few rows a file is asked to have, neither a first version nor a commit makes files without end."""
    monkeypatch.setattr(snapshots, "MAX_FILES", 8)
    root = str(tmp_path / "store")
    shops = lambda df: df.selectExpr("id", "concat('s', id) as name")
    snapshots.write_store({"shop": shops(spark.range(0, 2000, 2))}, root, file_rows=5)
    assert 2 <= len(files(spark, root, "shop", 1)) <= 8
    # one file is written anew as one, not cut into as many as a table may have
    snapshots.commit(spark, root, {"shop": Delta(shops(spark.range(2, 3)))}, file_rows=5)
    assert len(files(spark, root, "shop", 2)) == len(files(spark, root, "shop", 1))
    snapshots.commit(spark, root, {"shop": Delta(shops(spark.range(1, 2400)))}, file_rows=5)
    after = files(spark, root, "shop", 3)
    assert len(after) <= 8 + 8 + 4 and sum(n for n, _, _ in after.values()) == len({*range(0, 2000, 2), *range(1, 2400)})
    assert sorted(r.id for r in snapshots.read_snapshot(spark, root)["shop"].collect()) == sorted({*range(0, 2000, 2), *range(1, 2400)})


def test_pages_of_files_that_overlap_in_a_chain(spark, tmp_path):
    """Every file overlaps the next, so all are one group; still only those about the page are read."""
    from ledgerloom.sources import newest

    root = str(tmp_path / "store")
    shops = lambda df: df.selectExpr("id", "concat('s', id % 7) as name")
    snapshots.write_store({"shop": shops(spark.range(0, 2000, 2))}, root, file_rows=50)
    snapshots.commit(spark, root, {"shop": Delta(shops(spark.range(1, 1999, 2)))}, file_rows=70)
    ids = sorted([*range(0, 2000, 2), *range(1, 1999, 2)], reverse=True)
    groups = newest.directory(spark, root, "shop")
    assert max(len(g.files) for g in groups) >= 6
    got = lambda df: [r.id for r in df.collect()]
    for n in (1, 2, 3, 17, 50, 99, 100, 101):
        page = newest.page(spark, root, "shop", n)
        assert got(page) == ids[(n - 1) * 20 : n * 20] and len(page.inputFiles()) <= 5
    for k in (1, 30, 700, 5000):
        assert got(newest.newest(spark, root, "shop", k)) == ids[:k]
        of_name = newest.newest(spark, root, "shop", k, F.col("name") == "s3")
        assert got(of_name) == [i for i in ids if i % 7 == 3][:k]
    assert len(newest.newest(spark, root, "shop", 3, F.col("name") == "s3").inputFiles()) <= 4
