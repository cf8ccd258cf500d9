"""Fixed table schemas. Every table has a BIGINT ``id``; a foreign key ``x`` is ``x_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: table name -> schema as DDL text
DDL: dict[str, str] = {
    "shop": "id bigint, name string, telephone string, address string, opendate date, note string",
    "depot": "id bigint, name string, address string, hidden boolean, note string",
    "category": "id bigint, name string, pid_id bigint, hidden boolean",
    "products": (
        "id bigint, name string, barcode string, image string, category_id bigint, "
        "size string, hidden boolean, note string"
    ),
    "staff": (
        "id bigint, user_id bigint, name string, sex string, image string, edu string, "
        "marital boolean, school string, graduation date, address string, cellphone string, "
        "idcode string, homephone string, shop_id bigint, level smallint, joindate date, "
        "exwork string, family string, note string"
    ),
    "payslip": "id bigint, staff_id bigint, pay decimal(7,2), date date, note string",
    "customer": (
        "id bigint, name string, code string, shop_id bigint, telephone string, "
        "address string, joindate date, hidden boolean, note string"
    ),
    "instream": (
        "id bigint, code string, supplier smallint, date date, keeper_id bigint, "
        "staff1_id bigint, staff2_id bigint, note string, log string, hidden boolean"
    ),
    "indetail": (
        "id bigint, inid_id bigint, product_id bigint, value decimal(8,2), quantity int, "
        "depot_id bigint, depotdetail string"
    ),
    "outstream": (
        "id bigint, code string, date timestamp_ntz, keeper_id bigint, staff1_id bigint, "
        "staff2_id bigint, shop_id bigint, hidden boolean, returned boolean, note string, log string"
    ),
    "outdetail": "id bigint, outid_id bigint, product_id bigint, quantity int, depot_id bigint",
    "sellorder": (
        "id bigint, code string, customer_id bigint, shop_id bigint, staff_id bigint, "
        "discount decimal(8,2), date timestamp_ntz, hidden boolean, note string"
    ),
    "sellorderdetail": (
        "id bigint, oid_id bigint, product_id bigint, quantity int, price decimal(8,2)"
    ),
    "remit": (
        "id bigint, supplier smallint, amount decimal(8,2), staff_id bigint, date date, "
        "hidden boolean, note string"
    ),
    "posts": "id bigint, title string, note string, date date, hidden boolean",
}

#: table name -> {column: type}
TABLES: dict[str, dict[str, str]] = {
    table: dict(column.split(" ", 1) for column in ddl.split(", ")) for table, ddl in DDL.items()
}

#: ledger line table -> (header table, foreign key column)
LINE_HEADER = {
    "indetail": ("instream", "inid_id"),
    "outdetail": ("outstream", "outid_id"),
    "sellorderdetail": ("sellorder", "oid_id"),
}

#: One submitted order document. All leaves arrive as text and are cast after validation.
ORDER_DOC = (
    "id string, hidden string, code string, customer string, discount string, note string, "
    "date string, orderDetail array<struct<id:string, product:string, price:string, quantity:string>>"
)

#: The whole edited category tree, in list order.
CATEGORY_NODE = "struct<id:bigint, name:string, pId:bigint>"
CATEGORY_DOC = f"array<{CATEGORY_NODE}>"


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the declared columns and types of ``table``.

    Columns the input lacks become typed nulls, so partial extracts load too.
    """
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f'`{name}`' if name in have else 'null'} as {kind}) as `{name}`"
            for name, kind in TABLES[table].items()
        ]
    )
