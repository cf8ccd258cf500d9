"""Product flows and weighted-average cost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import half_even_div, line_cents, money
from ledgerloom.operators.stock import about_products, visible_issues, visible_receipts

Tables = Mapping[str, DataFrame]


def product_summary(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Per product: average cost, stock on hand, latest purchase price, in and out totals.

    Visible headers only. The average is 0 without receipts, else rounded half to even. With
    ``ids`` (a column ``id``) only those products, whose lines are picked before anything is summed.
    """
    products = t["products"].select(F.col("id").alias("product_id"))
    if ids is not None:
        picked = ids.select(F.col("id").alias("product_id"))
        products = products.join(picked, "product_id", "left_semi")
        t = about_products(t, picked)
    receipts = visible_receipts(t).select(
        "product_id",
        F.col("quantity").cast("bigint").alias("_in"),
        F.lit(0).cast("bigint").alias("_out"),
        line_cents("quantity", "value").alias("_cents"),
        "value",
        "id",
    )
    issues = visible_issues(t).select(
        "product_id",
        F.lit(0).cast("bigint").alias("_in"),
        F.col("quantity").cast("bigint").alias("_out"),
        F.lit(0).cast("bigint").alias("_cents"),
        F.lit(None).cast("decimal(8,2)").alias("value"),
        F.lit(None).cast("bigint").alias("id"),
    )
    flows = (
        receipts.unionByName(issues)
        .groupBy("product_id")
        .agg(
            F.sum("_in").alias("in_qty"),
            F.sum("_out").alias("out_qty"),
            F.sum("_cents").alias("in_cents"),
            F.max_by("value", "id").alias("last_value"),
        )
    )
    zero = F.lit(0).cast("bigint")
    in_qty, out_qty = F.coalesce("in_qty", zero), F.coalesce("out_qty", zero)
    return (
        products
        .join(flows, "product_id", "left")
        .select(
            "product_id",
            money(F.coalesce(half_even_div(F.col("in_cents"), F.col("in_qty")), zero)).alias("avg_cost"),
            (in_qty - out_qty).alias("on_hand"),
            "last_value",
            in_qty.alias("in_qty"),
            out_qty.alias("out_qty"),
        )
    )


def received(receipts: DataFrame) -> DataFrame:
    """Cents paid for and quantity of each received product; their quotient is the mean cost."""
    sums = receipts.groupBy("product_id").agg(
        F.sum(line_cents("quantity", "value")).alias("in_cents"),
        F.sum(F.col("quantity").cast("bigint")).alias("in_qty"),
    )
    return sums.filter(F.col("in_qty") != 0)
