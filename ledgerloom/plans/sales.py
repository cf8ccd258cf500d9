"""Order amounts, customer and shop series, product sales."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions.money import line_amount, money
from ledgerloom.functions.predicates import visible
from ledgerloom.operators import stock
from ledgerloom.operators.dense import fill_days
from ledgerloom.operators.lookup import fk_lookup
from ledgerloom.operators.orders import net_visible_orders, with_total
from ledgerloom.operators.paging import top_k
from ledgerloom.operators.stock import with_share

Tables = Mapping[str, DataFrame]


def _zero():
    return F.lit(0).cast("bigint")


def order_total(t: Tables) -> DataFrame:
    """Every order with its total."""
    return with_total(t, t["sellorder"].select("id", "discount"), whole=True).select(
        F.col("id").alias("oid_id"), "total"
    )


def customer_amount(t: Tables) -> DataFrame:
    """Lifetime spend per customer over visible orders with lines; NULL without any."""
    spend = (
        net_visible_orders(t, "customer_id", where=F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(money(F.sum("net_cents")).alias("amount"))
    )
    return (
        t["customer"]
        .select(F.col("id").alias("customer_id"), "name")
        .join(spend, "customer_id", "left")
        .select("customer_id", "name", "amount")
    )


def customer_orders_series(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Net amount of each visible order, by customer and date."""
    where = F.col("customer_id").isNotNull()
    if customer_id is not None:
        where = F.col("customer_id") == customer_id
    return net_visible_orders(t, "customer_id", "date", where=where).select(
        "customer_id",
        F.col("id").alias("oid_id"),
        F.to_date("date").alias("day"),
        money(F.col("net_cents")).alias("amount"),
    )


def shop_daily_sales(
    t: Tables, *, as_of: date, days: int = K.DASHBOARD_DAYS, head_office: str = K.HEAD_OFFICE
) -> DataFrame:
    """Net sales per shop and day, zero-filled, for the ``days`` ending at ``as_of``.

    The day range filters order headers before anything is joined or shuffled.
    """
    start = F.date_sub(F.lit(str(as_of)).cast("date"), days - 1)
    end = F.date_add(F.lit(str(as_of)).cast("date"), 1)
    window = (F.col("date") >= start.cast("timestamp_ntz")) & (F.col("date") < end.cast("timestamp_ntz"))
    sales = (
        net_visible_orders(t, "shop_id", "date", where=window)
        .groupBy("shop_id", F.to_date("date").alias("day"))
        .agg(F.sum("net_cents").alias("cents"))
    )
    shops = t["shop"].filter(F.col("name") != head_office).select(F.col("id").alias("shop_id"), "name")
    return fill_days(shops, "shop_id", sales, "cents", as_of, days).select(
        "shop_id", "name", "day", money(F.col("cents")).alias("amount")
    )


def recent_orders(t: Tables, n: int = K.RECENT_ORDERS) -> DataFrame:
    """The newest visible orders, newest first; totals and names are looked up for those rows only."""
    newest = top_k(
        t["sellorder"].filter(visible()).select("id", "shop_id", "staff_id", "discount", "date"),
        n,
        F.col("id").desc(),
    )
    df = fk_lookup(with_total(t, newest), "shop_id", t["shop"], shop="name")
    return fk_lookup(df, "staff_id", t["staff"], staff="name").select(
        "id", "shop", "staff", "total", "date"
    ).orderBy(F.col("id").desc())


def notice_list(t: Tables) -> DataFrame:
    return t["posts"].filter(visible()).select("id", "title", "note", "date").orderBy(F.col("id").desc())


def product_daily_sales(t: Tables, product_id: int | None = None, shop_id: int | None = None) -> DataFrame:
    """Quantity sold per product and day with the product's total; zero days dropped."""
    sales = stock.visible_sales(t, shop_id="shop_id", date="date")
    if product_id is not None:
        sales = sales.filter(F.col("product_id") == product_id)
    if shop_id is not None:
        sales = sales.filter(F.col("shop_id") == shop_id)
    daily = (
        sales.groupBy("product_id", F.to_date("date").alias("day"))
        .agg(F.sum(F.col("quantity").cast("bigint")).alias("quantity"))
    )
    return with_share(daily, "quantity", key="product_id").drop("share")


def product_units_sold(t: Tables, shop_id: int | None = None) -> DataFrame:
    """Lifetime units sold of every product, in all shops or one."""
    orders = t["sellorder"].filter(visible())
    if shop_id is not None:
        orders = orders.filter(F.col("shop_id") == shop_id)
    sold = (
        t["sellorderdetail"]
        .join(orders.select(F.col("id").alias("oid_id")), "oid_id", "left_semi")
        .groupBy("product_id")
        .agg(F.sum(F.col("quantity").cast("bigint")).alias("units_sold"))
    )
    return (
        t["products"]
        .select(F.col("id").alias("product_id"))
        .join(sold, "product_id", "left")
        .select("product_id", F.coalesce("units_sold", _zero()).alias("units_sold"))
    )


def product_card(t: Tables, level: int = 1, shop_id: int | None = None) -> DataFrame:
    """One wide row per product; the average cost is shown to levels under 5 only."""
    categories = t["category"].alias("c").join(
        t["category"].alias("p"), F.col("c.pid_id") == F.col("p.id"), "left"
    ).select(
        F.col("c.id").alias("category_id"),
        F.col("c.name").alias("category"),
        F.col("p.name").alias("parent"),
    )
    shelf = stock.shop_product_stock(t).groupBy("product_id").agg(F.sum("stock").alias("shop_stock"))
    avg = F.col("avg_cost") if level < 5 else F.lit(None).cast("decimal(20,2)")
    return (
        t["products"]
        .select(F.col("id").alias("product_id"), "name", "barcode", "size", "category_id", "hidden", "note")
        .join(categories, "category_id", "left")
        .join(stock_summary(t), "product_id", "left")
        .join(product_units_sold(t, shop_id), "product_id", "left")
        .join(shelf, "product_id", "left")
        .select(
            "product_id", "name", "parent", "category", "barcode", "size",
            avg.alias("avg_cost"), "units_sold", "in_qty", "out_qty", "on_hand",
            F.coalesce("shop_stock", _zero()).alias("shop_stock"), "hidden", "note",
        )
    )


def stock_summary(t: Tables) -> DataFrame:
    from ledgerloom.operators.cost import product_summary

    return product_summary(t)


def order_lines(t: Tables, oid: int | None = None) -> DataFrame:
    """Lines of orders with product name and size, and the order's discount and note."""
    lines, orders = t["sellorderdetail"], t["sellorder"]
    if oid is not None:
        lines, orders = lines.filter(F.col("oid_id") == oid), orders.filter(F.col("id") == oid)
    heads = orders.select(F.col("id").alias("oid_id"), "discount", "note")
    df = fk_lookup(lines.join(heads, "oid_id"), "product_id", t["products"], pname="name", psize="size")
    return df.select(
        "id", "oid_id", "product_id", "pname", "psize", "price", "quantity",
        line_amount("quantity", "price").alias("amount"), "discount", "note",
    )
