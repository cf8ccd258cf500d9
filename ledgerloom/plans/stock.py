"""Stock, cost and movement-document queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import staff_label, supplier_label
from ledgerloom.functions.money import cents, half_up_cents, line_amount, line_cents, money, share_of_cost
from ledgerloom.functions.predicates import visible
from ledgerloom.operators import cost, stock
from ledgerloom.operators.lookup import fk_lookup, lines_of
from ledgerloom.operators.stock import with_share

Tables = Mapping[str, DataFrame]

product_summary = cost.product_summary
shop_product_stock = stock.shop_product_stock
depot_product_stock = stock.depot_product_stock


def _zero():
    return F.lit(0).cast("bigint")


# -- positions -------------------------------------------------------------------------


def _listed(t: Tables, positions: DataFrame) -> DataFrame:
    products = t["products"].filter(visible()).select(
        F.col("id").alias("product_id"), "name", "barcode", "size"
    )
    return positions.join(products, "product_id")


def shop_stock_list(t: Tables, shop_id: int | None = None) -> DataFrame:
    """Stock of visible products per shop."""
    df = _listed(t, shop_product_stock(t))
    return df if shop_id is None else df.filter(F.col("shop_id") == shop_id)


def depot_stock_list(t: Tables, depot_id: int | None = None) -> DataFrame:
    """Stock of visible products per depot."""
    df = _listed(t, depot_product_stock(t))
    return df if depot_id is None else df.filter(F.col("depot_id") == depot_id)


def shop_stock_total(t: Tables) -> DataFrame:
    """Stock per shop, head office included; zero rows dropped; total and share added."""
    shops = t["shop"].select(F.col("id").alias("shop_id"), "name")
    return with_share(stock.shop_totals(t).join(shops, "shop_id"), "stock")


def depot_stock_total(t: Tables) -> DataFrame:
    """Stock per depot; zero rows dropped; total and share added."""
    depots = t["depot"].select(F.col("id").alias("depot_id"), "name")
    return with_share(stock.depot_totals(t).join(depots, "depot_id"), "stock")


def product_by_depot(t: Tables, product_id: int | None = None) -> DataFrame:
    """Every product with its stock in every visible depot, empty ones included.

    The depot list is one small array per plan, exploded on each product row.
    """
    products = t["products"].select(F.col("id").alias("product_id"))
    if product_id is not None:
        products = products.filter(F.col("product_id") == product_id)
    depots = t["depot"].filter(visible()).agg(F.collect_list(F.struct("id", "name")).alias("d")).scalar()
    grid = products.select("product_id", F.inline(depots).alias("depot_id", "name"))
    about = stock.about_products(t, None if product_id is None else products)
    receipts = stock.visible_receipts(about).select("product_id", "depot_id", F.col("quantity").cast("bigint").alias("q"))
    issues = stock.visible_issues(about).select("product_id", "depot_id", (-F.col("quantity").cast("bigint")).alias("q"))
    net = receipts.unionByName(issues).groupBy("product_id", "depot_id").agg(F.sum("q").alias("stock"))
    return grid.join(net, ["product_id", "depot_id"], "left").select(
        "product_id", "depot_id", "name", F.coalesce("stock", _zero()).alias("stock")
    )


def product_by_depot_chart(t: Tables) -> DataFrame:
    """Non-empty (product, depot) positions over all depots, with the product's total and shares."""
    receipts = stock.visible_receipts(t).select("product_id", "depot_id", F.col("quantity").cast("bigint").alias("q"))
    issues = stock.visible_issues(t).select("product_id", "depot_id", (-F.col("quantity").cast("bigint")).alias("q"))
    net = receipts.unionByName(issues).groupBy("product_id", "depot_id").agg(F.sum("q").alias("stock"))
    return with_share(fk_lookup(net, "depot_id", t["depot"], name="name"), "stock", key="product_id")


def product_by_shop(t: Tables, product_id: int | None = None) -> DataFrame:
    """For each product the shops it was issued to and its stock there."""
    df = shop_product_stock(t)
    if product_id is not None:
        df = df.filter(F.col("product_id") == product_id)
    return df.join(t["shop"].select(F.col("id").alias("shop_id"), "name"), "shop_id")


def product_by_shop_chart(t: Tables) -> DataFrame:
    return with_share(product_by_shop(t), "stock", key="product_id")


# -- value -----------------------------------------------------------------------------


def depot_value(t: Tables) -> DataFrame:
    """Per depot: stock quantity and its value at mean cost.

    Receipts count for quantity even under hidden headers; issues and mean costs use
    visible ones. A product without visible receipts drops out of both sums.
    """
    positions = stock.net_stock(t["indetail"], stock.visible_issues(t), ["depot_id", "product_id"])
    valued = positions.join(cost.received(stock.visible_receipts(t)), "product_id")
    per_depot = valued.groupBy("depot_id").agg(
        F.sum("stock").alias("quantity"),
        F.sum(share_of_cost(F.col("stock"), F.col("in_cents"), F.col("in_qty"))).alias("_value"),
    )
    return (
        t["depot"]
        .select(F.col("id").alias("depot_id"), "name")
        .join(per_depot, "depot_id", "left")
        .select(
            "depot_id",
            "name",
            F.coalesce("quantity", _zero()).alias("quantity"),
            money(F.coalesce(half_up_cents(F.col("_value")), _zero())).alias("amount"),
        )
    )


def out_line_cost(t: Tables) -> DataFrame:
    """Each issue line with ``quantity * avg_cost``."""
    costs = product_summary(t).select("product_id", "avg_cost")
    return t["outdetail"].join(costs, "product_id").select(
        "id", "outid_id", "product_id", "quantity", line_amount("quantity", "avg_cost").alias("amount")
    )


def receipt_summary(t: Tables) -> DataFrame:
    """Per receipt: number of lines, quantity and amount; hidden receipts too; 0 without lines."""
    sums = t["indetail"].groupBy("inid_id").agg(
        F.count("*").alias("lines"),
        F.sum(F.col("quantity").cast("bigint")).alias("quantity"),
        F.sum(line_cents("quantity", "value")).alias("_cents"),
    )
    return t["instream"].select("id").join(sums, F.col("id") == F.col("inid_id"), "left").select(
        F.col("id").alias("inid_id"),
        F.coalesce("lines", _zero()).alias("lines"),
        F.coalesce("quantity", _zero()).alias("quantity"),
        money(F.coalesce("_cents", _zero())).alias("amount"),
    )


def issue_summary(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Per issue or return: quantity and value at mean cost over all receipts, hidden too.

    Products never received are left out of both sums. With ``ids`` (a column ``id``) only those documents.
    """
    lines, headers = t["outdetail"], t["outstream"].select("id")
    if ids is not None:
        headers = headers.join(ids, "id", "left_semi")
        lines = lines.join(ids.select(F.col("id").alias("outid_id")), "outid_id", "left_semi")
    valued = lines.join(cost.received(t["indetail"]), "product_id")
    q = F.col("quantity").cast("bigint")
    sums = valued.groupBy("outid_id").agg(
        F.sum(q).alias("quantity"), F.sum(share_of_cost(q, F.col("in_cents"), F.col("in_qty"))).alias("_value")
    )
    return headers.join(sums, F.col("id") == F.col("outid_id"), "left").select(
        F.col("id").alias("outid_id"),
        F.coalesce("quantity", _zero()).alias("quantity"),
        money(F.coalesce(half_up_cents(F.col("_value")), _zero())).alias("amount"),
    )


# -- documents -------------------------------------------------------------------------


def _people(t: Tables, df: DataFrame) -> DataFrame:
    df = fk_lookup(df, "keeper_id", t["staff"], keeper="name")
    label = staff_label(F.col("level"), F.col("name"))
    return fk_lookup(df, "staff1_id", t["staff"], staff1=label)


def receipt_list(t: Tables) -> DataFrame:
    """Receipts with supplier label, people and sums; sort by id descending."""
    headers = t["instream"].select("id", "code", "supplier", "date", "hidden", "keeper_id", "staff1_id")
    sums = receipt_summary(t).withColumnRenamed("inid_id", "id")
    return _people(t, headers.join(sums, "id")).select(
        "id", "code", supplier_label(F.col("supplier")).alias("supplier"), "date", "hidden",
        "keeper", "staff1", "lines", "quantity", "amount",
    )


def _out_list(t: Tables, returned: bool) -> DataFrame:
    headers = t["outstream"].filter(F.col("returned") if returned else ~F.col("returned")).select(
        "id", "code", "shop_id", "date", "hidden", "keeper_id", "staff1_id"
    )
    sums = issue_summary(t, headers.select("id")).withColumnRenamed("outid_id", "id")
    df = fk_lookup(_people(t, headers.join(sums, "id")), "shop_id", t["shop"], shop="name")
    return df.select("id", "code", "shop", "date", "hidden", "keeper", "staff1", "quantity", "amount")


def issue_list(t: Tables) -> DataFrame:
    return _out_list(t, returned=False)


def return_list(t: Tables) -> DataFrame:
    return _out_list(t, returned=True)


def receipt_lines(t: Tables, inid: int | None = None) -> DataFrame:
    """Receipt lines with a positive quantity."""
    df = t["indetail"].filter(F.col("quantity") > 0)
    if inid is not None:
        df = df.filter(F.col("inid_id") == inid)
    df = fk_lookup(df, "product_id", t["products"], product="name")
    df = fk_lookup(df, "depot_id", t["depot"], depot="name")
    return df.select(
        "id", "inid_id", "product_id", "product", "value", "quantity", "depot",
        line_amount("quantity", "value").alias("amount"),
    )


def issue_lines(t: Tables, outid: int | None = None, returned: bool = False) -> DataFrame:
    """Lines of issues (or returns) that were not deleted."""
    headers = t["outstream"].filter(F.col("returned") if returned else ~F.col("returned"))
    df = lines_of(t["outdetail"].filter(F.col("quantity") != 0), "outid_id", headers, shop_id="shop_id")
    if outid is not None:
        df = df.filter(F.col("outid_id") == outid)
    df = fk_lookup(df, "product_id", t["products"], product="name")
    df = fk_lookup(df, "depot_id", t["depot"], depot="name")
    return df.select(
        "id", "outid_id", "shop_id", "product_id", "product",
        F.abs("quantity").alias("quantity"), "depot", F.lit(0).cast("bigint").alias("shop_stock"),
    )


def return_lines_stock(t: Tables, outid: int | None = None) -> DataFrame:
    """Return lines with the current stock of their product in the returning shop."""
    lines = issue_lines(t, outid, returned=True).drop("shop_stock")
    return lines.join(
        shop_product_stock(t, None if outid is None else lines).withColumnRenamed("stock", "shop_stock"),
        ["shop_id", "product_id"], "left",
    )


# -- searches by product ---------------------------------------------------------------


def receipt_search(t: Tables, product_id: int | None = None, depot_id: int | None = None) -> DataFrame:
    """Receipts (hidden too) that hold a product, with its quantity in the receipt.

    A depot narrows which receipts match, not the quantity shown.
    """
    lines = t["indetail"].filter(F.col("quantity") > 0)
    if product_id is not None:
        lines = lines.filter(F.col("product_id") == product_id)
    q = F.sum(F.col("quantity").cast("bigint")).alias("product_qty")
    sums = lines.groupBy("inid_id", "product_id").agg(
        q, F.max(F.lit(True) if depot_id is None else F.col("depot_id") == depot_id).alias("_hit")
    )
    headers = t["instream"].select(F.col("id").alias("inid_id"), "code", "date", "hidden")
    return sums.filter("_hit").drop("_hit").join(headers, "inid_id")


def issue_search(
    t: Tables,
    product_id: int | None = None,
    *,
    returned: bool = False,
    depot_id: int | None = None,
    shop_id: int | None = None,
    with_hidden: bool = False,
) -> DataFrame:
    """Issues or returns that hold a product, its quantity there and the total over all matches."""
    headers = t["outstream"].filter(F.col("returned") if returned else ~F.col("returned"))
    if shop_id is not None:
        headers = headers.filter(F.col("shop_id") == shop_id)
    if not with_hidden:
        headers = headers.filter(visible())
    lines = t["outdetail"].filter(F.col("quantity") != 0)
    if product_id is not None:
        lines = lines.filter(F.col("product_id") == product_id)
    picked = headers.select(F.col("id").alias("outid_id"), "code", "shop_id", "date", "hidden")
    # pick the lines of the matching documents before they are summed
    lines = lines.join(picked.select("outid_id"), "outid_id", "left_semi")
    sums = lines.groupBy("outid_id", "product_id").agg(
        F.sum(F.col("quantity").cast("bigint")).alias("product_qty"),
        F.max(F.lit(True) if depot_id is None else F.col("depot_id") == depot_id).alias("_hit"),
    )
    found = sums.filter("_hit").drop("_hit").join(picked, "outid_id")
    totals = found.groupBy("product_id").agg(F.sum("product_qty").alias("total_qty"))
    return found.join(totals, "product_id")
