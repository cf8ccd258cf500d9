"""Submitted order and category documents.

Documents are data: they are parsed against a fixed schema and never evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import squash
from ledgerloom.operators.running import running_total
from ledgerloom.schemas import CATEGORY_DOC, CATEGORY_NODE, ORDER_DOC


def parse_orders(df: DataFrame, text: str | Column = "value", *carry: str) -> DataFrame:
    """JSON text -> one row per order.

    Ids and flags lose their white space; code, discount and note keep it, and are
    checked without it.
    """
    doc = F.from_json(F.col(text) if isinstance(text, str) else text, ORDER_DOC)
    df = df.select(*carry, doc.alias("doc"))
    text_of = lambda name: F.coalesce(F.col(f"doc.{name}"), F.lit(""))
    return df.select(
        *carry,
        *[squash(text_of(name)).alias(name) for name in ("id", "hidden", "customer")],
        *[text_of(name).alias(name) for name in ("code", "discount", "note")],
        F.coalesce(F.col("doc.date"), F.lit("")).alias("date"),
        F.col("doc.orderDetail").alias("lines"),
    )


def order_doc_lines(orders: DataFrame, *carry: str) -> DataFrame:
    """One row per line, ``line_no`` from 1 in document order."""
    exploded = orders.select(*carry, F.posexplode("lines").alias("pos", "line"))
    return exploded.select(
        *carry,
        (F.col("pos") + 1).alias("line_no"),
        F.coalesce("line.id", F.lit("")).alias("line_id"),
        "line.product", "line.price", "line.quantity",
    )


def read_order_docs(spark: SparkSession, path: str) -> DataFrame:
    """Order documents, one JSON object per text line."""
    return parse_orders(spark.read.text(path))


def parse_categories(df: DataFrame, text: str | Column = "value") -> DataFrame:
    """JSON list of nodes -> rows (ordinal, id, name, pId) in list order."""
    doc = F.from_json(F.col(text) if isinstance(text, str) else text, CATEGORY_DOC)
    return df.select(F.posexplode(doc).alias("ordinal", "node")).select(
        "ordinal", "node.id", "node.name", "node.pId"
    )


def read_category_docs(spark: SparkSession, path: str) -> DataFrame:
    """Files with one JSON list of nodes each -> rows (ordinal, id, name, pId) in list order.

    A list may be larger than what one task can hold. It is cut at every closing brace, by as many tasks as the file has
    splits; a brace ends a node if the quotes before it are even in number, which running sums over the splits tell.
    The pieces of a node are put together again and parsed alone. Nodes are flat: a nested object would end one.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    counted = running_total(pieces, ["_file"], [F.col("_split")], [F.col("_at")], {"_quotes": quotes.cast("bigint")})
    ends = F.when(F.col("_quotes") % 2 == 0, 1).otherwise(0).cast("bigint")
    placed = running_total(counted, ["_file"], [F.col("_split")], [F.col("_at")], {"_ended": ends})
    parts = F.array_sort(F.collect_list(F.struct("_split", "_at", "value")))
    nodes = placed.groupBy("_file", (F.col("_ended") - ends).alias("ordinal")).agg(parts.alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["value"]), "}")
    # in front of a node stand the opening bracket or a comma; behind the last one there is none
    node = F.from_json(F.concat(F.regexp_replace(text, r"^[\s,\[]*", ""), F.lit("}")), CATEGORY_NODE)
    found = nodes.filter(F.contains(text, F.lit("{"))).select(F.col("ordinal").cast("int").alias("ordinal"), node.alias("node"))
    return found.select("ordinal", "node.id", "node.name", "node.pId")
