"""Sales and stock reports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import DISCOUNT_TOTAL, PAID_TOTAL
from ledgerloom.functions.labels import status_label
from ledgerloom.functions.money import cents, line_amount, money
from ledgerloom.functions.predicates import order_filter, visible
from ledgerloom.operators import stock
from ledgerloom.operators.cost import product_summary
from ledgerloom.operators.lookup import fk_lookup
from ledgerloom.operators.orders import with_total
from ledgerloom.operators.running import id_block, number_rows

Tables = Mapping[str, DataFrame]


def sales_report_lines(t: Tables, *, as_of: date, **fields) -> DataFrame:
    """One numbered row per line of the matching orders, by order date.

    Numbers come from per-day and per-block counts, so no task sees the whole report.
    """
    orders = t["sellorder"].filter(order_filter(as_of=as_of, **fields)).select(
        F.col("id").alias("oid_id"), "shop_id", "date"
    )
    df = t["sellorderdetail"].join(orders, "oid_id")
    df = number_rows(
        df,
        [F.col("date"), F.col("oid_id"), F.col("id")],
        [F.to_date("date"), F.col("date"), id_block("oid_id")],
        name="no",
    )
    df = fk_lookup(df, "shop_id", t["shop"], shop="name")
    df = fk_lookup(df, "product_id", t["products"], product="name", size="size", category_id="category_id")
    df = fk_lookup(df, "category_id", t["category"], category="name")
    return df.select(
        "no", "shop", "date", "product", "size", "category", "price", "quantity",
        line_amount("quantity", "price").alias("subtotal"),
    )


def sales_report_footer(t: Tables, *, as_of: date, **fields) -> DataFrame:
    """Discount and paid totals over all matching orders, those without lines too."""
    orders = with_total(t, t["sellorder"].filter(order_filter(as_of=as_of, **fields)))
    zero = F.lit(0).cast("bigint")
    return orders.agg(
        money(F.coalesce(F.sum(cents("discount")), zero)).alias("discount_total"),
        money(F.coalesce(F.sum(cents("total")), zero)).alias("paid_total"),
    )


def sales_report(t: Tables, *, as_of: date, **fields) -> DataFrame:
    """Report text rows under the fixed headings, footer last (``ordinal`` sorts it there)."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = ["no", "shop", "date", "product", "size", "category", "price", "quantity", "subtotal"]
    body = sales_report_lines(t, as_of=as_of, **fields).select(
        F.col("no").alias("ordinal"), *[s(c).alias(c) for c in names if c != "date"],
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
    )
    blank = F.lit("")
    footer = sales_report_footer(t, as_of=as_of, **fields).select(
        F.lit(2**63 - 1).alias("ordinal"),
        *[blank.alias(c) for c in ("no", "shop", "product", "size")],
        F.lit(DISCOUNT_TOTAL).alias("category"),
        s("discount_total").alias("price"),
        F.lit(PAID_TOTAL).alias("quantity"),
        s("paid_total").alias("subtotal"),
        blank.alias("date"),
    )
    return body.unionByName(footer).select("ordinal", *names)


def stock_report(t: Tables, container: str = "shop", container_id: int | None = None) -> DataFrame:
    """Visible products in a shop or depot, product id descending, numbered from 2."""
    key = f"{container}_id"
    positions = stock.shop_product_stock(t) if container == "shop" else stock.depot_product_stock(t)
    if container_id is not None:
        positions = positions.filter(F.col(key) == container_id)
    # Number the narrow rows first; names and sums do not change which rows there are.
    listed = t["products"].filter(visible()).select(F.col("id").alias("product_id"))
    df = positions.join(listed, "product_id", "left_semi")
    df = number_rows(
        df, [F.col("product_id").desc()], [-id_block("product_id")], keys=[key], name="no", start=2
    )
    products = t["products"].select(F.col("id").alias("product_id"), "name", "barcode", "size", "hidden")
    asked = None if container_id is None else positions.select(F.col("product_id").alias("id"))
    on_hand = product_summary(t, asked).select("product_id", F.col("on_hand").alias("depot_stock"))
    df = df.join(products, "product_id").join(on_hand, "product_id")
    return df.select(
        key, "no", "product_id", "name", "barcode", "size", "stock", "depot_stock",
        status_label(F.col("hidden")).alias("status"),
    )
