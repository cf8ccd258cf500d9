"""A hand-made ledger holding every edge row the rules speak of."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D

from ledgerloom.schemas import DDL, conform
from ledgerloom.sources.tables import Tables

AS_OF = date(2012, 6, 30)


def at(day: int, hour: int = 10, month: int = 6) -> datetime:
    return datetime(2012, month, day, hour)


ROWS = {
    "shop": [dict(id=1, name="总部"), dict(id=2, name="East"), dict(id=3, name="West")],
    "depot": [
        dict(id=1, name="North", hidden=False), dict(id=2, name="South", hidden=False), dict(id=3, name="Old", hidden=True),
    ],
    "category": [
        dict(id=1, name="Home", pid_id=None, hidden=False), dict(id=2, name="Bed", pid_id=1, hidden=False),
        dict(id=3, name="Sheet", pid_id=2, hidden=False), dict(id=4, name="Quilt", pid_id=2, hidden=True),
        dict(id=5, name="Bath", pid_id=1, hidden=False),
    ],
    "products": [
        dict(id=1, name="Silk_Sheet", barcode="10001", category_id=3, size="230,180", hidden=False),
        dict(id=2, name="Wool quilt 50%", barcode=None, category_id=4, size=None, hidden=False),
        dict(id=3, name="Towel", barcode="10003", category_id=5, size="70,140", hidden=True),
        dict(id=4, name="Never received", barcode="10004", category_id=5, size=None, hidden=False),
        dict(id=5, name="Hidden receipt only", barcode="10005", category_id=5, size=None, hidden=False),
        dict(id=6, name="towel", barcode="10003", category_id=5, size=None, hidden=False),
    ],
    "staff": [
        dict(id=1, name="Li", shop_id=2, level=5), dict(id=2, name="Wu", shop_id=2, level=6),
        dict(id=3, name="He", shop_id=3, level=99), dict(id=4, name="Bo", shop_id=3, level=0),
        dict(id=5, name="Ma", shop_id=3, level=4),
    ],
    "customer": [
        dict(id=1, name="王小", code="C001", shop_id=2, telephone="13500000001", hidden=False),
        dict(id=2, name="李大", code=None, shop_id=2, telephone=None, hidden=False),
        dict(id=3, name="王小", code="C003", shop_id=3, telephone="13500000003", hidden=True),
    ],
    "instream": [
        dict(id=1, code="IN01", supplier=1, date=date(2012, 1, 1), keeper_id=1, staff1_id=1, hidden=False),
        dict(id=2, code="IN02", supplier=2, date=date(2012, 1, 2), keeper_id=1, staff1_id=1, hidden=True),
        dict(id=3, code="IN03", supplier=4, date=date(2012, 1, 3), keeper_id=1, staff1_id=1, hidden=False),
    ],
    "indetail": [
        dict(id=1, inid_id=1, product_id=1, value=D("10.00"), quantity=10, depot_id=1),
        dict(id=2, inid_id=1, product_id=1, value=D("10.01"), quantity=10, depot_id=2),  # mean 10.005
        dict(id=3, inid_id=1, product_id=2, value=D("3.00"), quantity=3, depot_id=1),
        dict(id=4, inid_id=2, product_id=1, value=D("99.00"), quantity=5, depot_id=1),  # hidden header
        dict(id=5, inid_id=2, product_id=5, value=D("7.00"), quantity=4, depot_id=1),
        dict(id=6, inid_id=1, product_id=3, value=D("2.00"), quantity=8, depot_id=3),
        dict(id=7, inid_id=1, product_id=2, value=D("4.00"), quantity=0, depot_id=1),
    ],
    "outstream": [
        dict(id=1, code="OUT1", date=at(1), keeper_id=1, staff1_id=1, shop_id=2, hidden=False, returned=False),
        dict(id=2, code="OUT2", date=at(2), keeper_id=1, staff1_id=1, shop_id=2, hidden=False, returned=True),
        dict(id=3, code="OUT3", date=at(3), keeper_id=1, staff1_id=1, shop_id=3, hidden=True, returned=False),
        dict(id=4, code="OUT4", date=at(4), keeper_id=1, staff1_id=1, shop_id=1, hidden=False, returned=False),
    ],
    "outdetail": [
        dict(id=1, outid_id=1, product_id=1, quantity=6, depot_id=1),
        dict(id=2, outid_id=2, product_id=1, quantity=-2, depot_id=1),
        dict(id=3, outid_id=3, product_id=1, quantity=9, depot_id=1),
        dict(id=4, outid_id=1, product_id=3, quantity=2, depot_id=3),
        dict(id=5, outid_id=1, product_id=4, quantity=1, depot_id=1),  # never received
        dict(id=6, outid_id=1, product_id=2, quantity=0, depot_id=1),
        dict(id=7, outid_id=4, product_id=2, quantity=1, depot_id=1),
    ],
    "sellorder": [
        dict(id=1, code="SO01", customer_id=1, shop_id=2, staff_id=1, discount=D("1.00"), date=at(29), hidden=False, note="a"),
        dict(id=2, code=None, customer_id=1, shop_id=2, staff_id=1, discount=None, date=at(29, 15), hidden=False, note="b"),
        dict(id=3, code="SO03", customer_id=None, shop_id=2, staff_id=2, discount=D("0.50"), date=at(30), hidden=True, note=None),
        dict(id=4, code="SO04", customer_id=2, shop_id=3, staff_id=2, discount=D("5.00"), date=at(30), hidden=False, note="c"),
    ],
    "sellorderdetail": [
        dict(id=1, oid_id=1, product_id=1, quantity=1, price=D("20.00")),
        dict(id=2, oid_id=1, product_id=3, quantity=2, price=D("5.25")),
        dict(id=3, oid_id=2, product_id=1, quantity=1, price=D("22.00")),
        dict(id=4, oid_id=3, product_id=1, quantity=4, price=D("1.00")),
    ],
    "remit": [dict(id=1, supplier=1, amount=D("100.00"), staff_id=1, date=date(2012, 1, 1), hidden=False)],
    "payslip": [],
    "posts": [dict(id=1, title="x", hidden=False), dict(id=2, title="y", hidden=True)],
}


def table(spark, name: str, rows: list[dict]):
    columns = [c.split(" ", 1)[0] for c in DDL[name].split(", ")]
    return conform(spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], DDL[name]), name)


def ledger(spark, **replace) -> Tables:
    rows = {**ROWS, **replace}
    return Tables({name: (lambda n=name: table(spark, n, rows[n])) for name in DDL})


def by(df, *keys):
    """Rows keyed by one or more columns."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
