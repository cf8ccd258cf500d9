"""Stock positions from signed movements.

Inflow and outflow lines become one stream of signed quantities and are summed in a
single grouping: one shuffle of map-side partial sums, no join of two aggregates. A
group exists only where the inflow side has a line, which is what a left join from
inflow to outflow gives; a flag column carries that through the sum.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.predicates import visible
from ledgerloom.operators.lookup import lines_of, visible_lines

Tables = Mapping[str, DataFrame]


def visible_receipts(t: Tables) -> DataFrame:
    return visible_lines(t["indetail"], "inid_id", t["instream"])


def visible_issues(t: Tables) -> DataFrame:
    return visible_lines(t["outdetail"], "outid_id", t["outstream"])


def visible_issues_by_shop(t: Tables) -> DataFrame:
    return lines_of(t["outdetail"], "outid_id", t["outstream"].filter(visible()), shop_id="shop_id")


def visible_sales(t: Tables, **columns: str) -> DataFrame:
    return lines_of(t["sellorderdetail"], "oid_id", t["sellorder"].filter(visible()), **columns)


def about_products(t: Tables, products: DataFrame | None) -> Tables:
    """The tables with only the lines of some products (a column ``product_id``), picked before they are joined or summed."""
    if products is None:
        return t
    picked = products.select("product_id").distinct()
    names = ("indetail", "outdetail", "sellorderdetail")
    return ChainMap({n: t[n].join(picked, "product_id", "left_semi") for n in names if n in t}, t)


def net_stock(
    inflow: DataFrame, outflow: DataFrame, keys: Sequence[str], name: str = "stock"
) -> DataFrame:
    """Inflow minus outflow ``quantity`` per ``keys``, for keys that have an inflow line."""
    amount: Column = F.col("quantity").cast("bigint")
    moves = inflow.select(*keys, amount.alias("_q"), F.lit(True).alias("_in")).unionByName(
        outflow.select(*keys, (-amount).alias("_q"), F.lit(False).alias("_in"))
    )
    sums = moves.groupBy(*keys).agg(F.sum("_q").alias(name), F.max("_in").alias("_in"))
    return sums.filter("_in").drop("_in")


def shop_product_stock(t: Tables, products: DataFrame | None = None) -> DataFrame:
    """Shop x product: visible issues to the shop minus visible sales in it; with ``products`` only of those."""
    t = about_products(t, products)
    return net_stock(
        visible_issues_by_shop(t), visible_sales(t, shop_id="shop_id"), ["shop_id", "product_id"]
    )


def depot_product_stock(t: Tables, products: DataFrame | None = None) -> DataFrame:
    """Depot x product: visible receipts minus visible issues; with ``products`` only of those."""
    t = about_products(t, products)
    return net_stock(visible_receipts(t), visible_issues(t), ["depot_id", "product_id"])


def depot_totals(t: Tables) -> DataFrame:
    return net_stock(visible_receipts(t), visible_issues(t), ["depot_id"])


def shop_totals(t: Tables) -> DataFrame:
    return net_stock(visible_issues_by_shop(t), visible_sales(t, shop_id="shop_id"), ["shop_id"])


def with_share(df: DataFrame, value: str, *, key: str | None = None) -> DataFrame:
    """Drop zero rows, add the series total and each row's percentage of it."""
    df = df.filter(F.col(value) != 0)
    if key is None:
        total = df.agg(F.sum(value).cast("bigint").alias("t")).scalar()
        df = df.withColumn("total", total)
    else:
        # at most one row per place in a group, so a window over the group stays small
        df = df.withColumn("total", F.sum(value).over(Window.partitionBy(key)))
    share = F.try_divide(F.col(value).cast("double") * 100, F.col("total").cast("double"))
    return df.withColumn("share", share)
