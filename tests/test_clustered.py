"""Ledgers stored by month: same results, and what is read for them."""

from __future__ import annotations

from datetime import date

import pytest

from ledgerloom.plans import sales, search, stock
from ledgerloom.schemas import TABLES
from ledgerloom.sources import clustered
from tests.ledger import by, ledger


@pytest.fixture(scope="module")
def t(spark):
    """The hand-made ledger with 24 months of sales, one without a date, and a line without a header."""
    base = ledger(spark)
    orders = spark.range(100, 1300).selectExpr(
        "id", "concat('AA', id) as code", "1L as customer_id", "2L as shop_id", "1L as staff_id", "cast(1 as decimal(8,2)) as discount",
        "case when id > 100 then cast(add_months(date'2010-01-15', int(id % 24)) as timestamp_ntz) end as date", "false as hidden", "'n' as note",
    )
    lines = spark.range(1000, 5800).selectExpr("id", "case when id > 1000 then 100 + id % 1200 else 9999999 end as oid_id", "1L as product_id", "2 as quantity", "cast(3 as decimal(8,2)) as price")
    return base.replaced(sellorder=base["sellorder"].unionByName(orders), sellorderdetail=base["sellorderdetail"].unionByName(lines))


@pytest.fixture(scope="module")
def stored(spark, t, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("by-month") / "v")
    clustered.write_clustered(t, path)
    return clustered.read_clustered(spark, path)


def rows(df):
    return sorted(map(repr, df.collect()))


def read_files(df):
    """Rows that each scan put out and the files it opened, after running."""
    out = df._jdf.queryExecution()
    out.executedPlan().executeCollect()
    found = {}

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if hasattr(p, "plan") and "QueryStage" in p.getClass().getSimpleName():
            return walk(p.plan())
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            table = p.relation().location().rootPaths().head().getName()
            m = p.metrics()
            was = found.get(table, (0, 0))
            found[table] = (was[0] + m.apply("numFiles").value(), was[1] + m.apply("numOutputRows").value())
        children = p.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(out.executedPlan())
    return found


FIELDS = dict(as_of=date(2011, 6, 30), s_date=date(2011, 4, 1), e_date=date(2011, 6, 30), code="A")


def test_same_rows_and_results(t, stored):
    for name in ("sellorder", "sellorderdetail", "indetail", "outstream"):
        assert rows(stored[name].select(*TABLES[name])) == rows(t[name].select(*TABLES[name]))
    assert rows(search.order_search(stored, **FIELDS)) == rows(search.order_search(t, **FIELDS)) != []
    assert rows(search.order_search_page(stored, page=2, **FIELDS)) == rows(search.order_search_page(t, page=2, **FIELDS)) != []
    assert rows(search.order_search_exact(stored, 150)) == rows(search.order_search_exact(t, 150)) != []
    assert rows(stock.shop_product_stock(stored)) == rows(stock.shop_product_stock(t))
    assert by(sales.order_total(stored), "oid_id") == by(sales.order_total(t), "oid_id")


def test_lines_lie_in_their_headers_month(stored):
    lines = stored["sellorderdetail"].select("oid_id", "month").join(
        stored["sellorder"].selectExpr("id as oid_id", "month as its"), "oid_id", "left"
    )
    assert lines.filter("month <> coalesce(its, 0)").count() == 0
    assert stored["sellorder"].filter("month = 0").count() == 1 and stored["sellorderdetail"].filter("oid_id = 9999999").first().month == 0


def test_a_search_reads_its_months_only(stored):
    months = stored["sellorder"].select("month").distinct().count()
    got = read_files(search.order_search(stored, **FIELDS))
    whole = read_files(stored["sellorder"].selectExpr("id"))
    # headers are read for the result and for picking lines: four months each time (the last one for its first midnight)
    assert months >= 24 and got["sellorder"][0] <= 2 * 4 < whole["sellorder"][0]
    asked = stored["sellorder"].filter("month between 201104 and 201107").count()
    assert got["sellorder"][1] <= 2 * asked
    assert got["sellorderdetail"][1] <= stored["sellorderdetail"].filter("month between 201104 and 201107").count()


def test_an_exact_id_reads_its_row_groups_and_its_months_lines(stored):
    """The header's files are left out by their statistics and bloom filters, the lines' by the header's month."""
    got = read_files(search.order_search_exact(stored, 150))
    month = stored["sellorder"].filter("id = 150").first().month
    assert got["sellorder"][1] <= 2 * stored["sellorder"].filter(f"month = {month}").count()
    assert got["sellorderdetail"][1] <= stored["sellorderdetail"].filter(f"month = {month}").count()
