"""State plus deltas equals a recount."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import cost, maintained, stock
from ledgerloom.plans import changes
from ledgerloom.session import cut
from ledgerloom.sources.snapshots import Delta
from tests.ledger import AS_OF, by, ledger
from tests.test_snapshots import jobs


def rows(df):
    return sorted(map(repr, df.collect()))


def same(state, t):
    again = maintained.build(t)
    for part, whole in zip(state, again):
        assert rows(part.select(*whole.columns)) == rows(whole)


def test_state_gives_the_counted_results(spark):
    t = ledger(spark)
    state = maintained.build(t)
    assert rows(maintained.shop_product_stock(state)) == rows(stock.shop_product_stock(t))
    assert rows(maintained.depot_product_stock(state)) == rows(stock.depot_product_stock(t))
    assert rows(maintained.product_summary(state, t["products"])) == rows(cost.product_summary(t))


def test_after_every_job(spark):
    t = ledger(spark)
    state = maintained.State(*map(cut, maintained.build(t)))
    for got in jobs(spark, t):
        if {"indetail", "instream", "outdetail", "outstream", "sellorder", "sellorderdetail"} & set(got.delta):
            same(maintained.advance(state, t, got.delta), got.tables)


def test_latest_price_is_repaired(spark):
    """The latest line goes, is hidden, is priced anew, moves to another product, and a new one comes."""
    t = ledger(spark)
    state = maintained.build(t)
    line = lambda **new: t["indetail"].filter("id = 2").withColumns({k: F.lit(v) for k, v in new.items()}).select(*t["indetail"].columns)
    for delta, last in (
        (Delta(deleted=t["indetail"].filter("id = 2").select("id")), 10), (Delta(line(value=7)), 7),
        (Delta(line(product_id=3)), 10), (Delta(line(id=50, value=8)), 8), (Delta(line(id=0, value=8)), 10.01),
    ):
        rows_ = None if delta.rows is None else delta.rows.selectExpr("cast(id as bigint) as id", "inid_id", "cast(product_id as bigint) as product_id", "cast(value as decimal(8,2)) as value", "quantity", "depot_id", "depotdetail")
        new = maintained.advance(state, t, {"indetail": Delta(rows_, delta.deleted)})
        assert float(by(maintained.product_summary(new, t["products"]), "product_id")[1].last_value) == last
    hidden = changes.soft_delete(t, "instream", spark.createDataFrame([(1,)], "id bigint"))
    new = maintained.advance(state, t, hidden.delta)
    same(new, hidden.tables)
    assert by(maintained.product_summary(new, t["products"]), "product_id")[1].last_value is None


def test_a_chain_of_changes(spark):
    t = ledger(spark)
    state = maintained.build(t)
    frame = spark.createDataFrame
    steps = [
        lambda t: changes.delete_issue_lines(t, frame([(1, 1)], "seq bigint, id bigint"), as_of=AS_OF),
        lambda t: changes.soft_delete(t, "sellorder", frame([(1,)], "id bigint")),
        lambda t: changes.delete_receipt_lines(t, frame([(1, 2)], "seq bigint, id bigint"), as_of=AS_OF),
    ]
    for step in steps:
        got = step(t)
        state = maintained.State(*map(cut, maintained.advance(state, t, got.delta)))
        t = got.tables.replaced(**{n: cut(got.tables[n]) for n in got.delta})
    same(state, t)


def test_only_touched_lines_are_summed(spark, tmp_path):
    """Above every ledger scan stands a join with what the change names, before anything is summed."""
    from ledgerloom.sources import tables

    tables.write_tables(ledger(spark), str(tmp_path / "v"))
    t = tables.load_tables(spark, str(tmp_path / "v"))
    state = maintained.build(ledger(spark))
    kept = maintained.State(*(spark.createDataFrame(p.collect(), p.schema) for p in state))
    got = changes.soft_delete(t, "outstream", spark.createDataFrame([(1,)], "id bigint"))
    text = maintained.advance(kept, t, got.delta).shop_stock._jdf.queryExecution().optimizedPlan().toString()
    scans = [x for x in text.splitlines() if "outdetail" in x or "Relation [id" in x and "outid_id" in x]
    assert scans and text.count("LeftSemi") >= len(scans)


def test_a_change_without_receipts_does_not_count_products(spark, monkeypatch):
    """Only ids are kept then; the latest prices stay as they are and no job sums the products' receipts."""
    kept, cut = [], maintained.cut
    monkeypatch.setattr(maintained, "cut", lambda df: kept.append(df.columns) or cut(df))
    t = ledger(spark)
    got = changes.soft_delete(t, "outstream", spark.createDataFrame([(1,)], "id bigint"))
    state = maintained.advance(maintained.build(t), t, got.delta)
    assert kept and all(columns == ["id"] for columns in kept)
    expected = maintained.build(got.tables)
    for part in maintained.State._fields:
        columns = sorted(getattr(expected, part).columns)
        rows = [sorted(map(repr, getattr(s, part).select(*columns).collect())) for s in (state, expected)]
        assert rows[0] == rows[1], part
