"""Order, product, customer and staff searches."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions.labels import customer_label, staff_label
from ledgerloom.functions.predicates import order_filter, order_period, orders_in_scope, visible
from ledgerloom.functions.text import any_contains, icontains, raw_like
from ledgerloom.operators import stock
from ledgerloom.operators.cost import product_summary
from ledgerloom.operators.lookup import fk_lookup
from ledgerloom.operators.orders import with_total
from ledgerloom.operators.paging import page_slice, top_k, top_k_per
from ledgerloom.operators.running import id_block
from ledgerloom.sources.clustered import MONTH, within

Tables = Mapping[str, DataFrame]


# -- orders ----------------------------------------------------------------------------


def _in_period(t: Tables, as_of: date, fields: dict) -> Tables:
    """Of orders stored by month, the months a search can find something in."""
    return within(t, "sellorder", *order_period(as_of, fields.get("s_date"), fields.get("e_date")))


def order_search(t: Tables, *, as_of: date, **fields) -> DataFrame:
    """All orders matching the search fields (see ``order_filter``), with their totals."""
    t = _in_period(t, as_of, fields)
    return with_total(t, t["sellorder"].filter(order_filter(as_of=as_of, **fields))).drop(MONTH)


def order_rows(t: Tables, orders: DataFrame) -> DataFrame:
    """Display columns; an order without a customer shows a placeholder and id 0."""
    df = fk_lookup(orders, "customer_id", t["customer"], customer="name")
    df = fk_lookup(df, "staff_id", t["staff"], staff="name")
    return df.select(
        "id", "code", "total", "discount", F.to_date("date").alias("day"),
        F.coalesce("customer", F.lit(K.NO_CUSTOMER)).alias("customer"),
        F.coalesce("customer_id", F.lit(0).cast("bigint")).alias("customer_id"),
        "staff", "staff_id", "note", "hidden",
    )


def order_search_page(t: Tables, *, as_of: date, page: int = 1, **fields) -> DataFrame:
    """One page of matches, newest first; totals and names are computed for that page only."""
    t = _in_period(t, as_of, fields)
    matches = t["sellorder"].filter(order_filter(as_of=as_of, **fields))
    rows = page_slice(matches, [F.col("id").desc()], page, levels=[-id_block("id")])
    return order_rows(t, with_total(t, rows)).orderBy(F.col("id").desc())


def order_search_summary(t: Tables, *, as_of: date, **fields) -> DataFrame:
    """Number of matches, number of pages and grand total over all matches."""
    return order_search(t, as_of=as_of, **fields).agg(
        F.count("*").alias("rows"),
        F.ceil(F.count("*") / K.PAGE_SIZE).alias("pages"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(30,2)").alias("t_total"),
    )


def order_search_simple(t: Tables, count: int, *, level: int, shop_id: int) -> DataFrame:
    """The newest ``count`` orders in scope, newest first, hidden ones included."""
    rows = top_k(t["sellorder"].filter(orders_in_scope(level, shop_id)), count, F.col("id").desc())
    return order_rows(t, with_total(t, rows)).orderBy(F.col("id").desc())


def order_search_exact(t: Tables, order_id: int) -> DataFrame:
    row = t["sellorder"].filter((F.col("id") == order_id) & visible())
    return order_rows(t, with_total(t, row))


# -- products --------------------------------------------------------------------------


def _matching(t: Tables, q: str, limit: int | None) -> DataFrame:
    """Products, hidden too, whose name or barcode is LIKE ``q``.

    The text is wrapped in ``%`` only when a limit is given; without one it has to match
    the whole name or barcode.
    """
    pattern = q if limit is None else f"%{q}%"
    test = raw_like(F.col("name"), pattern) | raw_like(F.col("barcode"), pattern)
    return t["products"].filter(test).select(F.col("id").alias("product_id"), "name", "barcode", "size")


def sellable_products(t: Tables, q: str = "", limit: int | None = None, shop_id: int | None = None) -> DataFrame:
    """Per shop: matching products issued to it, with stock and the price of the latest sale.

    Zero stock and hidden products stay in. A limit keeps the best-stocked per shop.
    """
    sales = stock.visible_sales(t, shop_id="shop_id")
    issued = stock.visible_issues_by_shop(t)
    if shop_id is not None:
        sales, issued = sales.filter(F.col("shop_id") == shop_id), issued.filter(F.col("shop_id") == shop_id)
    # One grouping gives both the stock and the price of the last sale.
    q_ = F.col("quantity").cast("bigint")
    none_id, none_price = F.lit(None).cast("bigint"), F.lit(None).cast("decimal(8,2)")
    moves = issued.select(
        "shop_id", "product_id", q_.alias("q"), F.lit(True).alias("_in"), none_id.alias("id"), none_price.alias("price")
    ).unionByName(
        sales.select("shop_id", "product_id", (-q_).alias("q"), F.lit(False).alias("_in"), "id", "price")
    )
    sums = moves.groupBy("shop_id", "product_id").agg(
        F.sum("q").alias("stock"), F.max("_in").alias("_in"), F.max_by("price", "id").alias("price")
    )
    df = sums.filter("_in").join(_matching(t, q, limit), "product_id").select(
        "shop_id", "product_id", "name", "barcode", "stock",
        F.coalesce(F.col("price").cast("string"), F.lit("")).alias("price"),
        F.coalesce("size", F.lit("0")).alias("size"),
    )
    if limit is None:
        return df
    levels = [-F.shiftright("stock", 10), -F.col("stock"), id_block("product_id")]
    return top_k_per(df, ["shop_id"], limit, F.col("stock").desc(), F.col("product_id"), levels=levels)


def returnable_products(t: Tables, q: str = "%", shop_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Per shop: matching products with positive stock; hidden ones stay in.

    A limit only switches the ``%`` wrapping on; it never cuts this list.
    """
    df = stock.shop_product_stock(t).filter(F.col("stock") > 0)
    if shop_id is not None:
        df = df.filter(F.col("shop_id") == shop_id)
    return df.join(_matching(t, q, limit), "product_id").select(
        "shop_id", "product_id", "name", "barcode", "stock"
    )


def product_search(t: Tables, q: str, kind: str = "simple", limit: int | None = None) -> DataFrame:
    """Visible products whose name or barcode contains ``q``; ``mini`` adds stock and price.

    A ``limit`` (screens show ``SEARCH_LIMIT``) keeps the first by id.
    """
    found = t["products"].filter(visible() & any_contains(q, "name", "barcode")).select("id", "name", "barcode")
    if limit is not None:
        found = top_k(found, limit, F.col("id"))
    if kind == "simple":
        return found
    summary = product_summary(t, found.select("id")).select(F.col("product_id").alias("id"), "on_hand", "last_value")
    return found.join(summary, "id", "left")


# -- people ----------------------------------------------------------------------------


def customer_search(t: Tables, q: str, limit: int | None = None) -> DataFrame:
    """Visible customers whose name, code or telephone contains ``q``; a ``limit`` keeps the first by id."""
    found = t["customer"].filter(visible() & any_contains(q, "name", "code", "telephone")).select(
        "id", customer_label(F.col("name"), F.col("code"), F.col("telephone"), F.col("id")).alias("label")
    )
    return found if limit is None else top_k(found, limit, F.col("id"))


def staff_search(t: Tables, q: str, shop_id: int | None = None) -> DataFrame:
    found = t["staff"].filter((F.col("level") != 0) & icontains(F.col("name"), q))
    if shop_id is not None:
        found = found.filter(F.col("shop_id") == shop_id)
    return found.select("id", "shop_id", staff_label(F.col("level"), F.col("name")).alias("label"))


def customer_list(t: Tables, shop_id: int | None = None) -> DataFrame:
    """All customers or one shop's, hidden too; sort by id descending."""
    df = t["customer"]
    if shop_id is not None:
        df = df.filter(F.col("shop_id") == shop_id)
    return fk_lookup(df, "shop_id", t["shop"], shop="name").select(
        "id", "name", "code", "telephone", "shop", "hidden"
    )
