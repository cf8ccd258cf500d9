"""Line ids of the derived ledgers, and that jobs derive them once."""

from datetime import datetime

import pytest

from ledgerloom.sources.sample import STAR, sample_tables
from registry.change_queries import order_edit_docs
from registry.core import QUERIES

# order, product, supplier, line number, quantity, ..., of which some are equal and some have no number
ROWS = [(o, p, 1, n, float(p), 10.0 * p, 0.0, 0.0, "N", "O", datetime(2001, 1, p)) for o, p, n in [
    (1, 1, None), (1, 2, 1), (1, 3, 1), (1, 3, 1), (1, 4, 4), (1, 5, 5), (1, 6, 7), (1, 7, 7), (1, 8, 6), (1, 9, 8), (1, 9, -2),
    (2, 1, 5), (2, 2, 7), (3, 1, 7), (4, 2, None), (4, 3, 6),
]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    spark.createDataFrame(ROWS, STAR["lineitem"]).write.parquet(f"{path}/lineitem.parquet")
    return sample_tables(spark, path)


def test_ids_are_places_in_the_whole_order(tables):
    ids = {}
    for order in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == order), key=lambda r: (r[3] is not None, r[3] or 0, r[1]))
        for place, r in enumerate(own, 1):
            ids[order * 1000 + place] = (r[3], r[1])
    for table, wanted in (("indetail", [-2, 1, 2, 3, 4]), ("outdetail", [5, 6]), ("sellorderdetail", [7])):
        got = {r.id: r.product_id for r in tables[table].select("id", "product_id").collect()}
        assert got == {i: p for i, (n, p) in ids.items() if n in wanted}


def test_only_lines_that_count_are_shuffled(tables):
    plan = tables["indetail"]._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 4)" in plan[plan.index("Window") :]


@pytest.mark.parametrize("table", ["outdetail", "sellorderdetail"])
def test_lines_before_a_ledger_are_counted_not_sorted(tables, table):
    plan = tables[table].select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan[plan.index("Window") :]
    # a ledger of which no ids are asked for does not count them either
    plan = tables[table].select("product_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("name", ["maintained_product_summary", "delete_receipt_lines", "edit_receipt_lines", "edit_issue_lines", "apply_order_edits"])
def test_jobs_derive_lines_once(spark, sf_dir, name):
    assert "l_linenumber" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_order_edits_gather_lines_once(spark, sf_dir):
    plan = order_edit_docs(sample_tables(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
