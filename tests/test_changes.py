"""Change jobs against one-change-at-a-time replays in plain Python."""

import random
import re
from collections import defaultdict
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import admission
from ledgerloom.plans import changes
from ledgerloom.plans import stock as stock_plans
from ledgerloom.sources import documents
from tests.ledger import AS_OF, ROWS, at, by, ledger


@pytest.fixture(scope="module")
def t(spark):
    return ledger(spark)


def random_ledger(seed: int):
    """Receipts and issues over 3 products and 3 depots, one product holding most lines."""
    rnd = random.Random(seed)
    products = [dict(id=i, name=f"p{i}", category_id=3, hidden=False) for i in range(1, 4)]
    pick = lambda: 1 if rnd.random() < 0.6 else rnd.randrange(1, 4)
    ins = [dict(id=i, code=f"IN{i}", supplier=1, date=date(2012, 1, 1), hidden=i == 3) for i in range(1, 6)]
    outs = [dict(id=i, code=f"OUT{i}", date=at(1), shop_id=2 + i % 2, hidden=i == 2, returned=False) for i in range(1, 6)]
    indetail = [
        dict(id=i, inid_id=rnd.randrange(1, 6), product_id=pick(), value=D("2.50"), quantity=rnd.randrange(1, 12),
             depot_id=rnd.randrange(1, 4)) for i in range(1, 41)
    ]
    outdetail = [
        dict(id=i, outid_id=rnd.randrange(1, 6), product_id=pick(), quantity=rnd.randrange(0, 6),
             depot_id=rnd.randrange(1, 4)) for i in range(1, 31)
    ]
    return dict(products=products, instream=ins, outstream=outs, indetail=indetail, outdetail=outdetail), rnd


def visible_sums(rows, hidden, fk):
    total = defaultdict(int)
    for r in rows:
        if r[fk] not in hidden:
            total[r["product_id"], r["depot_id"]] += r["quantity"]
            total[r["product_id"], None] += r["quantity"]
    return total


@pytest.fixture(params=[1_000_000, 0], ids=["replayed", "bounded"])
def replay_rows(request, monkeypatch):
    real = admission.admit_in_order
    monkeypatch.setattr(changes, "admit_in_order", lambda *a: real(*a, replay_rows=request.param))


def test_delete_receipt_lines(spark, replay_rows):
    rows, rnd = random_ledger(1)
    order = rnd.sample([r["id"] for r in rows["indetail"]], 30)
    lines = {r["id"]: r for r in rows["indetail"]}
    for i in order:
        ins = visible_sums(lines.values(), {3}, "inid_id")
        out = visible_sums(rows["outdetail"], {2}, "outid_id")
        p = lines[i]["product_id"]
        if ins[p, None] - lines[i]["quantity"] > out[p, None]:
            del lines[i]
    batch = spark.createDataFrame([*enumerate(order), (90, order[0]), (91, 777)], "seq bigint, id bigint")
    got = changes.delete_receipt_lines(ledger(spark, **rows), batch, as_of=AS_OF, operator="Li")
    assert set(by(got.tables["indetail"], "id")) == set(lines)
    reasons = {r.seq: r.reason for r in got.rejected.collect()}
    # a further request meets a line that is gone, or fails for stock again
    assert reasons[90] == ("stock_issued" if order[0] in lines else "unknown_id") and reasons[91] == "unknown_id"
    assert got.audit.count() == len(rows["indetail"]) - len(lines)


@pytest.mark.parametrize("repeats", [False, True])
def test_edit_receipt_lines(spark, replay_rows, repeats):
    rows, rnd = random_ledger(2)
    lines = {r["id"]: dict(r) for r in rows["indetail"]}
    picked = rnd.choices(list(lines), k=25) + rnd.sample(list(lines), 20) if repeats else rnd.sample(list(lines), 35)
    edits = [(n, i, f"{n}.5", str(rnd.randrange(1, 9)), rnd.randrange(1, 4), "s") for n, i in enumerate(picked)]
    refused, before = set(), {}
    for seq, i, value, quantity, depot, _ in edits:
        ins = visible_sums(lines.values(), {3}, "inid_id")
        out = visible_sums(rows["outdetail"], {2}, "outid_id")
        p, less = lines[i]["product_id"], lines[i]["quantity"] - int(quantity)
        if less > ins[p, None] - out[p, None] or less > ins[p, depot] - out[p, depot]:
            refused.add(seq)
        else:
            before[seq] = f"原:{lines[i]['quantity']}套 单价{D(lines[i]['value']).quantize(D('0.01'))} "
            lines[i].update(quantity=int(quantity), depot_id=depot, value=D(value))
    long = "9" * 20
    bad = [
        (90, 1, "3.555", "1", 1, ""), (91, 2, "3", "0", 1, ""), (92, 3, "3", "1", 9, ""), (93, 4, "3", long, 1, ""),
        (94, 5, "3", "3000000000", 1, ""), (95, 6, "123456789", "1", 1, ""), (96, 7, long, "1", 1, ""),
    ]
    batch = spark.createDataFrame(edits + bad, "seq bigint, id bigint, value string, quantity string, depot_id bigint, depotdetail string")
    got = changes.edit_receipt_lines(ledger(spark, **rows), batch, as_of=AS_OF, operator="Li")
    new = by(got.tables["indetail"], "id")
    assert {i: (r.quantity, r.depot_id) for i, r in new.items()} == {i: (r["quantity"], r["depot_id"]) for i, r in lines.items()}
    assert all(r.value == lines[i]["value"] for i, r in new.items())
    reasons = {r.seq: r.reason for r in got.rejected.collect()}
    assert set(reasons) - set(range(90, 97)) == refused and refused
    assert [reasons[n] for n in range(90, 97)] == ["value", "quantity", "unknown_depot", "quantity", "quantity", "value", "value"]
    entries = {r.seq: r.entry for r in got.audit.collect()}
    assert set(entries) == set(before) and all(before[n] in e for n, e in entries.items())
    last = {i: n for n, i, *_ in edits if n in before}
    assert {r.seq for r in got.superseded.collect()} == set(before) - set(last.values())


@pytest.mark.parametrize("repeats", [False, True])
def test_edit_issue_lines(spark, replay_rows, repeats):
    rows, rnd = random_ledger(3)
    lines = {r["id"]: dict(r) for r in rows["outdetail"]}
    picked = rnd.choices(list(lines), k=30) + rnd.sample(list(lines), 15) if repeats else rnd.sample(list(lines), 28)
    edits = [(n, i, rnd.randrange(1, 4), str(rnd.randrange(1, 9))) for n, i in enumerate(picked)]
    ins = visible_sums(rows["indetail"], {3}, "inid_id")
    refused, before = {}, {}
    for seq, i, depot, quantity in edits:
        out = visible_sums(lines.values(), {2}, "outid_id")
        line, quantity = lines[i], int(quantity)
        p = line["product_id"]
        stock = ins[p, depot] - out[p, depot] if (p, depot) in ins else 0
        twin = any(
            o["id"] != i and (o["outid_id"], o["product_id"], o["depot_id"]) == (line["outid_id"], p, depot) and o["quantity"] > 0
            for o in lines.values()
        )
        if quantity > stock + line["quantity"]:
            refused[seq] = "over_depot_stock"
        elif twin:
            refused[seq] = "already_in_issue"
        else:
            before[seq] = f"原:{line['quantity']}套 仓库"
            line.update(quantity=quantity, depot_id=depot)
    for seq, quantity in ((90, "9" * 20), (91, "3000000000"), (92, None)):
        edits.append((seq, edits[0][1], 1, quantity))
        refused[seq] = "quantity"
    batch = spark.createDataFrame(edits, "seq bigint, id bigint, depot_id bigint, quantity string")
    got = changes.edit_issue_lines(ledger(spark, **rows), batch, as_of=AS_OF, operator="Li")
    new = by(got.tables["outdetail"], "id")
    assert {i: (r.quantity, r.depot_id) for i, r in new.items()} == {i: (r["quantity"], r["depot_id"]) for i, r in lines.items()}
    assert {r.seq: r.reason for r in got.rejected.collect()} == refused
    assert set(refused.values()) == {"over_depot_stock", "already_in_issue", "quantity"}
    entries = {r.seq: r.entry for r in got.audit.collect()}
    assert set(entries) == set(before) and all(before[n] in e for n, e in entries.items())


def doc(seq, shop=2, lines=(), **fields):
    base = dict(id="", hidden="", code="", customer="", discount="", note="", date="")
    base.update(fields)
    return dict(seq=seq, shop_id=shop, staff_id=1, moment=datetime(2012, 6, 30, 12), lines=list(lines), **base)


DOC = (
    "seq bigint, shop_id bigint, staff_id bigint, moment timestamp_ntz, lines array<struct<id:string,product:string,"
    "price:string,quantity:string>>, id string, hidden string, code string, customer string, discount string, note string, date string"
)


def docs(spark, rows):
    names = [c.strip().split(" ")[0] for c in (
        "seq,shop_id,staff_id,moment,lines,id,hidden,code,customer,discount,note,date").split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], DOC)


def test_apply_new_orders(spark, t, replay_rows):
    rnd = random.Random(5)
    stock = {(2, 1): 2, (2, 3): 0, (2, 4): 1, (2, 2): 0, (1, 2): 1}
    rows, want, errors = [], {}, {}
    for seq in range(1, 31):
        shop = rnd.choice([2, 2, 1])
        lines = [("", str(rnd.choice([1, 4, 2])), "9.5", "1") for _ in range(rnd.randrange(1, 3))]
        rows.append(doc(seq, shop, lines))
        left, short = dict(stock), None
        for n, (_, p, _, q) in enumerate(lines, 1):
            if left.get((shop, int(p)), 0) < int(q):
                short = short or n
            left[shop, int(p)] = left.get((shop, int(p)), 0) - int(q)
        if short:
            errors[seq] = ("over_stock", short)
        else:
            stock, want[seq] = left, 4 + len(want) + 1
    rows += [
        doc(40, 2, [("", "1", "9", "0")]), doc(41, 2, [("", "1", "x", "9")]), doc(42, 2, [("", "99", "1", "1")]),
        doc(43, 2, code="A!"), doc(44, 2, customer="77"), doc(45, 2, [("", "1", "1", "500"), ("", "1", "x", "1")]),
        doc(46, 2, customer="1", discount=" 2.5", code="AB12"),
        doc(47, 2, [("", "1", "1", "9" * 20)]), doc(48, 2, [("", "1", "123456789", "1")]), doc(49, 2, discount="9" * 12),
    ]
    errors |= {40: ("quantity", 1), 41: ("price", 1), 42: ("unknown_product", 1), 43: ("code", None),
               44: ("unknown_customer", None), 45: ("over_stock", 1), 47: ("quantity", 1), 48: ("price", 1), 49: ("discount", None)}
    got = changes.apply_new_orders(t, docs(spark, rows))
    want[46] = 4 + len(want) + 1
    assert {r.seq: r.id for r in got.added.collect()} == want
    assert {r.seq: (r.reason, r.line_no) for r in got.rejected.collect()} == errors
    orders = by(got.tables["sellorder"], "id")
    assert len(orders) == 4 + len(want) and orders[want[46]].discount == D("2.50") and orders[want[46]].customer_id == 1
    new_lines = got.tables["sellorderdetail"].filter("id > 4").orderBy("id").collect()
    assert [r.id for r in new_lines] == list(range(5, 5 + len(new_lines)))
    assert [r.oid_id for r in new_lines] == sorted(r.oid_id for r in new_lines)


def test_apply_order_edits(spark, t):
    day = "2012-06-01 08:00:00"
    rows = [
        doc(1, id="1", code="EDIT1", discount="3", date=day, lines=[("1", "1", "21", "3"), ("", "4", "2", "1"), ("4", "1", "7", "7")]),
        doc(2, id="2", hidden="1"),
        doc(3, id="3", code="EDIT3", date=day, lines=[]),
        doc(4, id="1", code="A!", date=day),
        doc(5, id="77", date=day), doc(6, id="4", date="2012-07-01 00:00:00"), doc(7, id="x"),
        doc(8, id="4", date=day, lines=[("abc", "1", "1", "1")]),
    ]
    got = changes.apply_order_edits(t, docs(spark, rows), as_of=AS_OF)
    lines = {i: (r.oid_id, r.quantity, r.price) for i, r in by(got.tables["sellorderdetail"], "id").items()}
    # line 2 is not named and goes; line 4 is named by another order, so its own order's edit drops it
    assert lines == {1: (1, 3, D("21.00")), 3: (2, 1, D("22.00")), 5: (1, 1, D("2.00"))}
    orders = by(got.tables["sellorder"], "id")
    assert orders[1].code == "EDIT1" and orders[1].date == datetime(2012, 6, 1, 8)
    assert orders[2].hidden and orders[2].date == at(29, 15) and not orders[3].hidden and orders[4].code == "SO04"
    assert {r.seq: r.reason for r in got.rejected.collect()} == {4: "code", 5: "unknown_id", 6: "future", 7: "id", 8: "line_id"}


def test_successive_order_edits(spark, t):
    day = "2012-06-01 08:00:00"
    rows = [
        doc(1, id="1", code="ONE11", date=day, lines=[("1", "1", "21", "3"), ("2", "1", "5", "5"), ("", "4", "2", "1")]),
        doc(2, id="1", code="!!", date=day, lines=[]),
        doc(3, id="1", code="GOOD1", discount="4", lines=[("1", "1", "22", "2"), ("", "4", "9", "7")]),
        doc(4, id="3", hidden="1"), doc(5, id="3", code="BACK1", lines=[("4", "1", "7", "7")]), doc(6, id="3", hidden="1"),
    ]
    got = changes.apply_order_edits(t, docs(spark, rows), as_of=AS_OF)
    assert {r.seq: r.reason for r in got.rejected.collect()} == {2: "code"}
    orders = by(got.tables["sellorder"], "id")
    assert orders[1].code == "GOOD1" and orders[1].discount == D("4.00") and orders[1].date == datetime(2012, 6, 1, 8)
    assert orders[3].hidden and orders[3].code == "BACK1"
    lines = {i: (r.oid_id, r.quantity, r.price) for i, r in by(got.tables["sellorderdetail"], "id").items()}
    # line 2 went with the third document, and so did the line that the first one added
    assert lines[1] == (1, 2, D("22.00")) and 2 not in lines and lines[5] == (1, 7, D("9.00"))
    assert sorted(i for i in lines if i > 4) == [5]


def test_order_edits_with_repeated_and_missing_seq(spark, t):
    day = "2012-06-01 08:00:00"
    rows = [
        # one seq for an edit and a document that hides another order: the lines of both count
        doc(1, id="1", code="ONE11", date=day, lines=[("1", "1", "21", "3")]), doc(1, id="2", hidden="1", lines=[("3", "1", "9", "4")]),
        # a bad line spoils all edits of its seq
        doc(2, id="3", code="THREE", date=day), doc(2, id="2", hidden="1", lines=[("", "77", "1", "1")]),
        # without seq: accepted, but of no effect on lines
        doc(None, id="4", code="FOUR4", date=day, lines=[("4", "1", "8", "8"), ("x", "1", "8", "8")]),
    ]
    got = changes.apply_order_edits(t, docs(spark, rows), as_of=AS_OF)
    assert [(r.seq, r.id, r.reason, r.line_no) for r in got.rejected.collect()] == [(2, "3", "unknown_product", 1)]
    lines = {i: (r.oid_id, r.quantity, r.price) for i, r in by(got.tables["sellorderdetail"], "id").items()}
    was = {i: (r.oid_id, r.quantity, r.price) for i, r in by(t["sellorderdetail"], "id").items()}
    assert lines == {1: (1, 3, D("21.00")), 3: (was[3][0], 4, D("9.00")), 4: was[4]}
    orders = by(got.tables["sellorder"], "id")
    assert orders[1].code == "ONE11" and orders[2].hidden and orders[3].code != "THREE" and orders[4].code != "FOUR4"


def test_order_edits_deal_out_stored_lines_by_id_and_order_only(spark, t):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [doc(1, id="1", code="EDIT1", lines=[("1", "1", "21", "3")])]
        gone = changes.apply_order_edits(t, docs(spark, rows), as_of=AS_OF).delta["sellorderdetail"].deleted
        plan = gone._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"SortMergeJoin \[(.*?)\], \[", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # a join on both would shuffle the lines once more
    assert sorted(k.split("#")[0] for k in keys) == ["id", "oid_id"] and all("," not in k for k in keys)
    # a line that many documents name is counted before it is shuffled
    assert "partial_count(1)" in plan and "REPARTITION" not in plan


def test_category_tree(spark, t):
    nodes = [
        (0, 1, "House", None), (1, 2, "Bed", 1), (2, 3, "Sheet", 0), (3, 5, "Bath", 100),
        (4, 100, "Kitchen", 1), (5, 102, "Early", 101), (6, 101, "Pan", 100), (7, 103, "Lid", 101), (8, 104, "Root", None),
        (9, 100, "Twice", 1),
    ]
    got = changes.apply_category_tree(t, spark.createDataFrame(nodes, "ordinal int, id bigint, name string, pId bigint"))
    tree = {i: (r.name, r.pid_id, r.hidden) for i, r in by(got.tables["category"], "id").items()}
    assert tree == {
        1: ("House", None, False), 2: ("Bed", 1, False), 3: ("Sheet", 2, False), 4: ("Quilt", 2, True), 5: ("Bath", 1, False),
        6: ("Kitchen", 1, False), 7: ("Pan", 6, False), 8: ("Lid", 7, False),
    }  # 3 and 5 name a parent that is not stored; a child before its parent and a new root are not added
    assert {r.id for r in got.rejected.collect()} == {102, 104}
    assert by(got.tables["products"], "id")[2].hidden  # its category left the list


def test_add_lines_and_upserts(spark, t):
    new = spark.createDataFrame(
        [
            (1, 1, 1, 1, "2.50", "3", "x"), (2, 1, 9, 1, "2.50", "3", "x"), (3, 1, 1, 1, "2.505", "3", "x"),
            (4, 1, 1, 1, "2", "9" * 20, "x"), (5, 1, 1, 1, "2", "3000000000", "x"), (6, 1, 1, 1, "1000000", "3", "x"),
        ],
        "seq bigint, inid_id bigint, product_id bigint, depot_id bigint, value string, quantity string, depotdetail string",
    )
    got = changes.add_receipt_lines(t, new)
    assert by(got.added, "seq")[1].id == 8 and {r.seq: r.reason for r in got.rejected.collect()} == {
        2: "unknown_product", 3: "value", 4: "quantity", 5: "quantity", 6: "value",
    }

    out = spark.createDataFrame(
        [(1, 1, 1, 1, "5"), (2, 3, 1, 1, "5"), (3, 3, 5, 1, "1"), (4, 1, 1, 1, "-5"), (5, 1, 1, 1, "9" * 20)],
        "seq bigint, outid_id bigint, product_id bigint, depot_id bigint, quantity string",
    )
    got = changes.add_issue_lines(t, out)
    # shop 2 has 2; the hidden document of shop 3 adds nothing
    assert {r.seq: r.shop_stock for r in got.added.collect()} == {1: 7, 2: 0, 3: 0}
    back = changes.add_issue_lines(t, out.filter("seq = 1"), returned=True)
    assert back.added.first().shop_stock == -3 and by(back.tables["outdetail"], "id")[8].quantity == -5

    bound = spark.createDataFrame([(3, 1), (3, 2), (77, 1)], "outid_id bigint, inid_id bigint")
    got = changes.copy_receipt_to_issue(t, bound)
    assert got.added.count() == 5
    assert {(r.outid_id, r.inid_id): r.reason for r in got.rejected.collect()} == {(3, 2): "unknown_receipt", (77, 1): "unknown_issue"}
    assert sorted(r.id for r in got.added.collect()) == [8, 9, 10, 11, 12]

    people = [(1, 1, "王小", "C0011"), (2, None, "赵一", None), (3, None, "Zhao", None), (4, 1, "王大", None), (5, 9, "王大", None), (6, 1, "W", None)]
    batch = spark.createDataFrame(people, "seq bigint, id bigint, name string, code string").select(
        "*", F.lit(3).cast("bigint").alias("shop_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("telephone", "address", "note")], F.lit(None).cast("date").alias("joindate"),
    )
    got = changes.upsert_customers(t, batch)
    new = by(got.tables["customer"], "id")
    assert new[1].name == "王大" and new[1].shop_id == 3 and new[4].name == "赵一" and not new[4].hidden and len(new) == 4
    assert {r.seq: r.reason for r in got.rejected.collect()} == {3: "name", 5: "unknown_id", 6: "name"}
    assert [r.seq for r in got.superseded.collect()] == [1]


def test_headers(spark, t):
    """Codes are unique in order of submission; links must exist; a new issue is listed."""
    names = "seq bigint, id bigint, code string, shop_id bigint, keeper_id bigint, staff1_id bigint, hidden boolean, note string, date timestamp_ntz"
    staff = {r.level: r.id for r in t["staff"].orderBy(F.desc("id")).collect() if r.level >= 5}
    clerk = next(iter(staff.values()))
    office = t["shop"].filter(F.col("name") == "总部").first()
    shop = t["shop"].filter(F.col("name") != "总部").first().id
    stored = t["outstream"].filter("code is not null").orderBy("id").first()
    when = datetime(2012, 6, 30)

    def row(seq, id=None, code=None, shop_id=shop, keeper=clerk):
        return seq, id, code, shop_id, keeper, clerk, False, "n", when

    batch = [
        row(1, code="NEW01"), row(2, code="NEW01"), row(3, code=stored.code), row(4, id=stored.id, code=stored.code),
        row(5, shop_id=777), row(6, keeper=888), row(7), row(8, id=stored.id, code="MOVED1"), row(9, code="MOVED1"),
    ]
    want = {2: "duplicate_code", 3: "duplicate_code", 5: "shop", 6: "keeper", 9: "duplicate_code"}
    if office is not None:
        batch.append(row(10, shop_id=office.id))
        want[10] = "shop"
    got = changes.upsert_headers(t, "outstream", spark.createDataFrame(batch, names), returned=True)
    assert {r.seq: r.reason for r in got.rejected.collect()} == want
    added = {r.seq: r.id for r in got.added.collect()}
    assert set(added) == {1, 7}
    assert by(got.tables["outstream"], "id")[stored.id].code == "MOVED1"
    assert [r.seq for r in got.superseded.collect()] == [4]
    new = by(got.tables["outstream"], "id")[added[1]]
    assert new.returned and not new.hidden
    assert set(added.values()) <= set(by(stock_plans.return_list(got.tables), "id"))

    bound = spark.createDataFrame([(*row(1, code="B0001"), 1), (*row(2), None), (*row(3), 2), (*row(4, shop_id=777), 1)], names + ", inid_id bigint")
    got = changes.add_bound_issues(t, bound)
    added = {r.seq: r.id for r in got.added.collect()}
    assert {r.seq: r.reason for r in got.rejected.collect()} == {3: "unknown_receipt", 4: "shop"} and set(added) == {1, 2}
    lines = got.tables["outdetail"].filter(F.col("outid_id") == added[1]).count()
    assert lines == t["indetail"].filter("inid_id = 1").count() > 0
    assert set(added.values()) <= set(by(stock_plans.issue_list(got.tables), "id"))


def test_products_only_enter_categories_of_the_form(spark, t):
    from ledgerloom.plans.catalog import product_form_categories

    offered = {r.id for r in product_form_categories(t).collect()}
    every = [r.id for r in t["category"].collect()]
    batch = spark.createDataFrame([(c, None, "Name", None, c, None, False, "") for c in [*every, 999]], "seq bigint, id bigint, name string, barcode string, category_id bigint, size string, hidden boolean, note string")
    got = changes.upsert_products(t, batch)
    assert {r.seq for r in got.added.collect()} == offered and offered < set(every)
    assert {r.seq: r.reason for r in got.rejected.collect()} == {c: "category" for c in [*every, 999] if c not in offered}


def test_ids_do_not_depend_on_how_dense_seq_is(spark, t):
    draw = random.Random(3)
    seqs = sorted(draw.randrange(1, 1 << 62) for _ in range(300))
    batch = spark.createDataFrame([(s, 1, 1, 1, "1", "1", "") for s in draw.sample(seqs, 300)], "seq bigint, inid_id bigint, product_id bigint, depot_id bigint, value string, quantity string, depotdetail string")
    got = changes.add_receipt_lines(t, batch)
    ids = {r.seq: r.id for r in got.added.collect()}
    assert [ids[s] for s in seqs] == list(range(8, 308))


def test_soft_delete_and_log(spark, t):
    ids = spark.createDataFrame([(1,), (99,)], "id bigint")
    got = changes.soft_delete(t, "instream", ids)
    assert {i: r.hidden for i, r in by(got.tables["instream"], "id").items()} == {1: True, 2: True, 3: False}
    assert got.rejected.first().reason == "unknown_id"
    gone = spark.createDataFrame([(1, 1), (2, 4)], "seq bigint, id bigint")
    got = changes.delete_issue_lines(t, gone, as_of=AS_OF, operator="Li")
    assert by(got.tables["outdetail"], "id")[1].quantity == 0
    log = by(changes.render_log(t["outstream"], got.audit), "id")[1].log
    rule = "-" * 31
    assert log == (
        f"2012-06-30 Li 删除 产品：Towel\n原:2套 仓库Old\n{rule}\n2012-06-30 Li 删除 产品：Silk_Sheet\n原:6套 仓库North\n{rule}\n"
    )
    assert len(ROWS["outdetail"]) == got.tables["outdetail"].count()


def test_documents(spark, tmp_path):
    text = '{"id":" 1 ","hidden":"","code":"A B","note":"n","orderDetail":[{"product":"1","price":"2","quantity":"3"},{"id":"5"}]}'
    (tmp_path / "o.json").write_text(text + "\n__import__('os')\n", encoding="utf8")
    orders = documents.read_order_docs(spark, str(tmp_path / "o.json"))
    first = orders.filter("id = '1'").first()
    assert first.code == "A B" and first.customer == ""
    assert [tuple(r) for r in documents.order_doc_lines(orders, "id").collect()] == [
        ("1", 1, "", "1", "2", "3"), ("1", 2, "5", None, None, None),
    ]
    (tmp_path / "c.json").write_text('[{"id":1,"name":"a","pId":null},\n {"id":2,"name":"b","pId":1}]', encoding="utf8")
    assert [tuple(r) for r in documents.read_category_docs(spark, str(tmp_path / "c.json")).orderBy("ordinal").collect()] == [
        (0, 1, "a", None), (1, 2, "b", 1),
    ]
