"""Tables, reports and what the scans read."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import visible_lines
from ledgerloom.plans import reports, sales, stock
from ledgerloom.sources import sinks, tables
from tests.ledger import AS_OF, by, ledger


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger") / "v1")
    tables.write_tables(ledger(spark), path)
    return path


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip(spark, stored):
    t = tables.load_tables(spark, stored)
    assert set(t) == set(ledger(spark))
    assert by(sales.order_total(t), "oid_id") == by(sales.order_total(ledger(spark)), "oid_id")
    with pytest.raises(Exception, match="already exists"):
        tables.write_tables({"shop": t["shop"]}, stored)


def test_scan_is_pruned_and_filtered(spark, stored):
    t = tables.load_tables(spark, stored)
    text = plan(sales.shop_daily_sales(t, as_of=AS_OF, days=7))
    scans = {re.search(r"/(\w+)\]", s).group(1): s for s in re.findall(r"FileScan parquet.*", text)}
    orders = scans["sellorder"]
    assert "IsNotNull(date), EqualTo(hidden,false)" in orders or ("hidden" in orders and "GreaterThanOrEqual(date" in orders)
    assert "note" not in orders.split("ReadSchema")[1] and "code" not in orders.split("ReadSchema")[1]
    assert "ReadSchema: struct<oid_id:bigint,quantity:int,price:decimal(8,2)>" in scans["sellorderdetail"]


def test_stock_is_one_shuffle(spark, stored):
    t = tables.load_tables(spark, stored)
    text = plan(stock.shop_product_stock(t))
    assert text.count("Exchange hashpartitioning(shop_id") == 1
    assert "partial_sum" in text


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    tables.write_bucketed(ledger(spark), "default", str(tmp_path / "b"), 4)
    names = ["instream", "indetail", "outstream", "outdetail", "sellorder", "sellorderdetail"]
    t = {n: spark.table(f"default.{n}") for n in names}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = visible_lines(t["indetail"], "inid_id", t["instream"])
        sums = lines.groupBy("inid_id").agg(F.sum("quantity").alias("q"))
        assert "Exchange" not in plan(sums)
        assert {r.inid_id: r.q for r in sums.collect()} == {1: 31}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"drop table default.{n}")


@pytest.mark.parametrize("single_file", [True, False])
def test_sales_report_file(spark, tmp_path, single_file):
    path = str(tmp_path / "report")
    sinks.write_sales_report_csv(reports.sales_report(ledger(spark), as_of=AS_OF), path, single_file=single_file)
    files = sorted(glob.glob(f"{path}/part-*.csv"))
    lines = []
    for name in files:
        raw = open(name, "rb").read()
        assert raw.startswith(b"\xef\xbb\xbf")
        head, *rest = raw.decode("utf-8-sig").splitlines()
        assert head == "编号,店铺,日期,产品名称,尺寸,类别,价格,数量,小计"
        lines += rest
    assert len(files) == 1 or not single_file
    assert lines[0].startswith('1,East,2012-06-29 10:00:00,Silk_Sheet,"230,180",Sheet,20.00,1,20.00')
    assert lines[-1].endswith("折扣总额,6.00,实收,29.50") and len(lines) == 3


def test_json_and_pipe_rows(spark, tmp_path):
    t = ledger(spark)
    docs = [r.doc for r in sinks.to_json_rows(t["category"].orderBy("id"), "id", "pid_id").collect()]
    assert docs[0] == '{"id":1,"pid_id":null}'
    assert sinks.pipe_rows(t["depot"].orderBy("id"), "id", "name", "note").first().line == "1|North|None"
    sinks.write_json(t["shop"].select("id", "note"), str(tmp_path / "j"))
    assert '{"id":1,"note":null}' in "".join(open(f).read() for f in glob.glob(str(tmp_path / "j/part-*")))


def test_lines_are_picked_before_they_are_summed(spark, stored):
    """No sum over a whole line ledger stands below the pick of a page or of matching documents."""
    from ledgerloom.plans import search
    from ledgerloom.plans import stock as stock_plans

    t = tables.load_tables(spark, stored)
    cases = [
        ("oid_id", sales.recent_orders(t)), ("oid_id", search.order_search_page(t, as_of=AS_OF)),
        ("oid_id", search.order_search_simple(t, 5, level=1, shop_id=1)), ("oid_id", search.order_search(t, as_of=AS_OF)),
        ("outid_id", stock_plans.issue_search(t, shop_id=2)), ("outid_id", stock_plans.issue_list(t)),
        ("inid_id", search.product_search(t, "a", kind="mini", limit=5)),
    ]
    for key, df in cases:
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        scans = [n for n, x in enumerate(lines) if "Relation [" in x and f"{key}#" in x]
        assert scans
        for n in scans:
            above, level = [], depth[n]
            for m in range(n - 1, -1, -1):
                if depth[m] < level:
                    above.append(lines[m].strip(" :+-").split(" ")[0:2])
                    level = depth[m]
            kinds = [" ".join(x) for x in above]
            first = next(k for k in kinds if k.startswith(("Aggregate", "Join LeftSemi")))
            assert first.startswith("Join LeftSemi"), kinds


def test_a_category_list_is_read_in_splits(spark, tmp_path):
    import json
    import random

    from ledgerloom.sources import documents

    rnd = random.Random(8)
    odd = ['plain', 'br}ace', 'qu"ote', 'back\\slash', '\\"}', '{"id":1}', 'é山}', '', ',[', 'line\nbreak}']
    nodes = [dict(id=i, name="".join(rnd.choice(odd) for _ in range(3)), pId=rnd.choice([None, i - 1])) for i in range(3000)]
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "a.json").write_text(json.dumps(nodes, indent=1, ensure_ascii=False))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = documents.read_category_docs(spark, str(tmp_path / "list"))
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "list")).rdd.getNumPartitions() > 5
        assert [(r.id, r.name, r.pId) for r in got.orderBy("ordinal").collect()] == [(n["id"], n["name"], n["pId"]) for n in nodes]
        assert [r.ordinal for r in got.orderBy("ordinal").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for i, (text, n) in enumerate([("[]", 0), ("", 0), ('[{"id": 1, "name": "a", "pId": null}]\n', 1)]):
        (tmp_path / f"f{i}").write_text(text)
        assert documents.read_category_docs(spark, str(tmp_path / f"f{i}")).count() == n


def test_a_local_warehouse_is_refused_on_a_cluster():
    from ledgerloom import session

    assert session.on_one_machine("local[8]") and session.on_one_machine("local") and not session.on_one_machine("spark://host:7077")
    assert session.is_local("file:/tmp/x") and not session.is_local("hdfs://name/x")
