"""Order amounts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import cents, line_cents, money
from ledgerloom.functions.predicates import visible

Tables = Mapping[str, DataFrame]


def gross_by_order(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Sum of ``quantity * price`` in cents for every order that has lines, or for those of ``orders`` only.

    The lines of the orders are picked before they are summed, so a page of orders shuffles its own lines.
    """
    lines = t["sellorderdetail"]
    if orders is not None:
        # in tables stored by month the orders' months prune the lines'
        by = ["oid_id", "month"] if "month" in lines.columns and "month" in orders.columns else ["oid_id"]
        lines = lines.join(orders.withColumn("oid_id", F.col("id")).select(*by), by, "left_semi")
    return lines.groupBy("oid_id").agg(F.sum(line_cents("quantity", "price")).alias("gross_cents"))


def with_total(t: Tables, orders: DataFrame, whole: bool = False) -> DataFrame:
    """Add ``total``: gross minus discount; 0 for an order without lines, discount or not.

    ``whole``: ``orders`` are all or most of the ledger, so picking lines first would gain nothing.
    """
    net = F.col("gross_cents") - F.coalesce(cents("discount"), F.lit(0).cast("bigint"))
    return (
        orders.join(gross_by_order(t, None if whole else orders), orders["id"] == F.col("oid_id"), "left")
        .withColumn("total", money(F.coalesce(net, F.lit(0).cast("bigint"))))
        .drop("oid_id", "gross_cents")
    )


def net_visible_orders(t: Tables, *columns: str, where=None) -> DataFrame:
    """Visible orders that have lines, with ``net_cents`` = gross minus discount."""
    orders = t["sellorder"].filter(visible())
    if where is not None:
        orders = orders.filter(where)
    # Join first: a narrow header filter then cuts the lines before they are shuffled, and
    # a shuffled join leaves the rows already grouped by order.
    picked = orders.select("id", "discount", *columns)
    lines = t["sellorderdetail"].select("oid_id", "quantity", "price")
    gross = (
        picked.join(lines, F.col("id") == F.col("oid_id"))
        .groupBy("id", "discount", *columns)
        .agg(F.sum(line_cents("quantity", "price")).alias("gross_cents"))
    )
    net = F.col("gross_cents") - F.coalesce(cents("discount"), F.lit(0).cast("bigint"))
    return gross.select("id", *columns, net.alias("net_cents"))
