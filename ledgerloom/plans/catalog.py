"""Categories, staff roster, choice lists, remittances and duplicates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions.labels import category_label as label_of
from ledgerloom.functions.labels import level_label, staff_label, supplier_label
from ledgerloom.functions.predicates import visible
from ledgerloom.operators.grouping import PART_ROWS, collect_groups
from ledgerloom.operators.lookup import fk_lookup
from ledgerloom.operators.running import id_block, number_rows

Tables = Mapping[str, DataFrame]


# -- categories ------------------------------------------------------------------------


def category_tree(t: Tables, parent_id: int | None = None) -> DataFrame:
    """Visible nodes, or the visible children of one; a root has pId 0."""
    df = t["category"].filter(visible())
    if parent_id is not None:
        df = df.filter(F.col("pid_id") == parent_id)
    return df.select("id", F.coalesce("pid_id", F.lit(0).cast("bigint")).alias("pId"), "name")


def category_label(t: Tables) -> DataFrame:
    """``parent-name`` of every node."""
    df = fk_lookup(t["category"], "pid_id", t["category"], parent="name")
    return df.select("id", label_of(F.col("name"), F.col("parent")).alias("label"))


def parent_ids(t: Tables) -> DataFrame:
    """Distinct ids some visible node names as its parent."""
    return (
        t["category"]
        .filter(visible() & F.col("pid_id").isNotNull())
        .select(F.col("pid_id").alias("parent_id"))
        .distinct()
    )


def leaf_categories(t: Tables) -> DataFrame:
    """Visible nodes that no visible node names as its parent, listed under their parent.

    ``position`` is the place in the parent's group, by id.
    """
    df = t["category"].filter(visible()).join(
        parent_ids(t), F.col("id") == F.col("parent_id"), "left_anti"
    )
    df = fk_lookup(df, "pid_id", t["category"], parent="name").withColumn(
        "group_id", F.coalesce("pid_id", F.lit(0).cast("bigint"))
    )
    df = number_rows(df, [F.col("id")], [id_block("id")], keys=["group_id"], name="position")
    return df.select("id", "name", "pid_id", "parent", "position")


def product_form_categories(t: Tables) -> DataFrame:
    """Visible nodes whose own parent is some visible node's parent."""
    return (
        t["category"]
        .filter(visible())
        .join(parent_ids(t), F.col("pid_id") == F.col("parent_id"), "left_semi")
        .select("id", "name", "pid_id")
    )


# -- staff -----------------------------------------------------------------------------


def staff_roster(t: Tables) -> DataFrame:
    """Current staff, shop descending then level, grouped by shop.

    ``position`` runs inside each shop's group.
    """
    df = t["staff"].filter(F.col("level") < K.LEVEL_LEFT)
    df = number_rows(
        df.select("id", "name", "shop_id", "level"),
        [F.col("level"), F.col("id")],
        [F.col("level"), id_block("id")],
        keys=["shop_id"],
        name="position",
    )
    return fk_lookup(df, "shop_id", t["shop"], shop="name").select(
        "id", "name", "shop_id", "shop", "level", level_label(F.col("level")).alias("level_label"), "position"
    )


def staff_groups(t: Tables, size: int = PART_ROWS) -> DataFrame:
    """Current staff collected under their shop, by level, in parts of at most ``size``."""
    df = t["staff"].filter(F.col("level") < K.LEVEL_LEFT)
    groups = collect_groups(
        df, ["shop_id"], [F.col("level"), F.col("id")], [F.col("level"), id_block("id")], ["id", "name", "cellphone", "level"], size
    )
    return fk_lookup(groups, "shop_id", t["shop"], shop="name")


def visible_staff_choice(t: Tables, at_least: int | None = None) -> DataFrame:
    """Staff offered in forms: below 99, or from a level up."""
    test = F.col("level") < K.LEVEL_LEFT if at_least is None else F.col("level") >= at_least
    return t["staff"].filter(test).select("id", staff_label(F.col("level"), F.col("name")).alias("label"))


def shop_choice(t: Tables, head_office: str = K.HEAD_OFFICE) -> DataFrame:
    return t["shop"].filter(F.col("name") != head_office).select("id", "name")


def receipt_choice(t: Tables) -> DataFrame:
    return t["instream"].filter(visible()).select("id", "code")


# -- remittances -----------------------------------------------------------------------


def remit_list(t: Tables) -> DataFrame:
    """Remittances with supplier and staff labels; sort by id descending."""
    label = staff_label(F.col("level"), F.col("name"))
    return fk_lookup(t["remit"], "staff_id", t["staff"], staff=label).select(
        "id", supplier_label(F.col("supplier")).alias("supplier"), "amount", "staff", "date", "hidden"
    )


# -- duplicates ------------------------------------------------------------------------


def _shared_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, count) for values more than one visible row has."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return (
        df.filter(visible())
        .select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count("*").alias("count"))
        .filter(F.col("count") > 1)
    )


def duplicate_products(t: Tables) -> DataFrame:
    return _shared_values(t["products"], ["name", "barcode"])


def duplicate_customers(t: Tables) -> DataFrame:
    return _shared_values(t["customer"], ["name", "code", "telephone"])


def is_duplicate(count, editing: bool):
    """Whether a found count is a conflict; a row being edited finds itself once."""
    return count > F.lit(1 if editing else 0)
