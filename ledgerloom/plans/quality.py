"""Data-quality rules.

``validate_<thing>(df)`` adds ``errors``, an array of rule codes, empty when the row is
good. Row rules are plain expressions; rules about repeated keys compare each row with
its key's first row, found by a map-side combined grouping.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions.dates import parse_day, parse_moment
from ledgerloom.functions.money import line_cents
from ledgerloom.functions.text import squash, trim_spaces


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _filled(name: str) -> Column:
    return _text(name) != ""


def _bad(name: str, pattern: str) -> Column:
    return ~_text(name).rlike(pattern)


def _bad_if_filled(name: str, pattern: str) -> Column:
    return _filled(name) & _bad(name, pattern)


def _too_long(name: str, limit: int = K.NOTE_MAX) -> Column:
    return F.length(_text(name)) > limit


def bad_quantity(name: str) -> Column:
    """Not a positive whole number that the ledger can hold."""
    number = _text(name).try_cast("bigint")
    return _bad(name, K.RE_QUANTITY) | F.coalesce(number > K.QUANTITY_MAX, F.lit(True))


def _bad_money(text: Column) -> Column:
    """Not an amount of at most two decimals that the ledger can hold."""
    return ~text.rlike(K.RE_MONEY) | F.coalesce(text.try_cast("decimal(20,2)") >= K.MONEY_BELOW, F.lit(True))


def bad_id(name: str) -> Column:
    """Neither empty nor an id."""
    return _filled(name) & (_bad(name, K.RE_ID) | _text(name).try_cast("bigint").isNull())


def errors_of(rules: dict[str, Column]) -> Column:
    """Codes of the broken rules, in rule order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))


def _with_errors(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("errors", errors_of(rules))


def mark_repeats(df: DataFrame, keys: Sequence[str], order: str, name: str = "repeated") -> DataFrame:
    """Flag rows that are not the first of their ``keys`` by ``order``."""
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return df.join(first, list(keys)).withColumn(name, F.col(order) > F.col("_first")).drop("_first")


# -- orders ----------------------------------------------------------------------------


def order_rules() -> dict[str, Column]:
    """Code, discount and note, judged without their white space."""
    code, discount, note = (squash(_text(name)) for name in ("code", "discount", "note"))
    return {
        "code": (code != "") & ~code.rlike(K.RE_CODE),
        "discount": (discount != "") & _bad_money(discount),
        "note": F.length(note) > K.NOTE_MAX,
    }


def order_edit_rules(as_of: date) -> dict[str, Column]:
    moment = parse_moment(_text("date"))
    in_shape = _text("date").rlike(K.RE_TIMESTAMP)
    end = F.date_add(F.lit(str(as_of)).cast("date"), 1).cast("timestamp_ntz")
    return {
        "id": _bad_if_filled("id", K.RE_ID),
        **order_rules(),
        "date": _filled("date") & (~in_shape | moment.isNull()),
        "future": _filled("date") & in_shape & F.coalesce(moment >= end, F.lit(False)),
    }


def validate_order(df: DataFrame, as_of: date | None = None) -> DataFrame:
    """Order header text fields; ``as_of`` adds the id and date rules of an edit."""
    return _with_errors(df, order_rules() if as_of is None else order_edit_rules(as_of))


def order_line_rules() -> dict[str, Column]:
    return {"price": _bad_money(_text("price")), "quantity": bad_quantity("quantity")}


def validate_order_line(df: DataFrame) -> DataFrame:
    return _with_errors(df, order_line_rules())


def first_bad_line(lines: DataFrame, order_key: str = "order_id") -> DataFrame:
    """Per order with a bad line: the first one's number and first broken rule."""
    bad = validate_order_line(lines).filter(F.size("errors") > 0)
    return bad.groupBy(order_key).agg(
        F.min("line_no").alias("line_no"), F.min_by(F.col("errors")[0], "line_no").alias("error")
    )


def validate_order_business(lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Cart rules per order.

    ``lines`` holds order_id, shop_id, product_id, name, price, quantity, discount;
    ``stock`` is ``shop_product_stock``. Both sides of the discount rule are cut to whole
    units; payable is what remains after the discount.
    """
    joined = lines.join(stock, ["shop_id", "product_id"], "left")
    over = F.col("quantity") > F.coalesce("stock", F.lit(0))
    orders = joined.groupBy("order_id").agg(
        F.sum(line_cents("quantity", "price")).alias("_gross"),
        F.max("discount").alias("discount"),
        F.max(over).alias("_over"),
    )
    twice = (
        lines.groupBy("order_id", trim_spaces(F.col("name")).alias("name"))
        .agg(F.count("*").alias("n"))
        .groupBy("order_id")
        .agg(F.max(F.col("n") > 1).alias("_twice"))
    )
    discount = F.coalesce((F.col("discount") * 100).cast("bigint"), F.lit(0).cast("bigint"))
    payable = F.col("_gross") - discount
    whole = lambda c: F.call_function("div", c, F.lit(100).cast("bigint"))
    return orders.join(twice, "order_id").select(
        "order_id",
        errors_of(
            {
                "discount_over_payable": whole(discount) > whole(payable),
                "over_stock": F.col("_over"),
                "duplicate_product": F.col("_twice"),
            }
        ).alias("errors"),
    )


def validate_search_params(df: DataFrame, as_of: date) -> DataFrame:
    """Order search text fields: code, customer, staff, note, sDate, eDate and the level."""
    start, end = parse_day(_text("sDate")), parse_day(_text("eDate"))
    today = F.lit(str(as_of)).cast("date")
    no = F.lit(False)
    return _with_errors(
        df,
        {
            "code": _bad("code", K.RE_CODE_SEARCH),
            "customer": _bad_if_filled("customer", K.RE_ID),
            "staff": _bad_if_filled("staff", K.RE_ID),
            "note": _too_long("note"),
            "s_date": _filled("sDate") & start.isNull(),
            "look_back": (F.col("level") > 5)
            & F.coalesce(start < F.date_sub(today, K.LOOKBACK_MAX_DAYS), no),
            "e_date": _filled("eDate") & end.isNull(),
            "e_date_future": F.coalesce(end > today, no),
            "order": F.coalesce(start > end, no),
        },
    )


def validate_view_request(df: DataFrame) -> DataFrame:
    """Requests for a view: level, days, wide (the dashboard's span) and view ('sales' or 'depots').

    Levels over 5 may look back so many days only; the depots are shown to levels under 5.
    """
    cap = F.when(F.coalesce("wide", F.lit(False)), K.DASHBOARD_MAX_DAYS_WIDE).otherwise(K.DASHBOARD_MAX_DAYS)
    level = F.coalesce("level", F.lit(K.LEVEL_LEFT))
    return _with_errors(
        df,
        {
            "days": (F.col("view") != "depots") & (level > 5) & (F.col("days") > cap),
            "view": (F.col("view") == "depots") & (level >= 5),
        },
    )


# -- movement documents ----------------------------------------------------------------


def receipt_line_rules() -> dict[str, Column]:
    return {
        "value": _bad_money(_text("value")),
        "quantity": bad_quantity("quantity"),
        "note": _too_long("depotdetail"),
    }


def validate_receipt_line(df: DataFrame) -> DataFrame:
    """Receipt lines as text; a receipt holds a product at most once per depot."""
    df = mark_repeats(df, ["inid_id", "product_id", "depot_id"], "id")
    return _with_errors(df, {**receipt_line_rules(), "repeated": F.col("repeated")}).drop("repeated")


def issue_line_rules() -> dict[str, Column]:
    return {"quantity": bad_quantity("quantity")}


def validate_issue_line(df: DataFrame) -> DataFrame:
    """Issue lines as text; an issue holds a product at most once per depot."""
    df = mark_repeats(df, ["outid_id", "product_id", "depot_id"], "id")
    return _with_errors(df, {**issue_line_rules(), "repeated": F.col("repeated")}).drop("repeated")


def stream_header_rules(kind: str) -> dict[str, Column]:
    """``kind`` is 'in' (supplier code) or 'out' (shop). Missing links are NULL.

    What a header's links must be like in other tables is added by ``linked_header_rules``.
    """
    party = {
        "in": F.coalesce(~F.col("supplier").isin(*K.SUPPLIERS), F.lit(True)),
        "out": F.col("shop_id").isNull(),
    }[kind]
    return {
        "code": _bad_if_filled("code", K.RE_CODE),
        "supplier" if kind == "in" else "shop": party,
        "date": F.col("date").isNull(),
        "keeper": F.col("keeper_id").isNull(),
        "staff1": F.col("staff1_id").isNull(),
        "note": _too_long("note"),
    }


def linked_header_rules(
    df: DataFrame, kind: str, staff: DataFrame, shops: DataFrame | None = None, head_office: str = K.HEAD_OFFICE
) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with look-ups (columns ``_...``), and the header rules with those on links.

    The keeper must be a staff member, the handler one of level 5 or above, and an issue's shop one
    that is known and not the head office.
    """
    rules = stream_header_rules(kind)
    levels = staff.select(F.col("id").alias("_sid"), F.col("level").alias("_level"))
    keepers = staff.select(F.col("id").alias("_keeper"))
    df = df.join(levels, F.col("staff1_id") == F.col("_sid"), "left").join(
        keepers, F.col("keeper_id") == F.col("_keeper"), "left"
    )
    rules["keeper"] = F.col("_keeper").isNull()
    rules["staff1"] = rules["staff1"] | F.coalesce(F.col("_level") < 5, F.lit(True))
    if kind == "out" and shops is not None:
        known = shops.filter(F.col("name") != head_office).select(F.col("id").alias("_shop"))
        df = df.join(known, F.col("shop_id") == F.col("_shop"), "left")
        rules["shop"] = F.col("_shop").isNull()
    return df, rules


def validate_stream_header(
    df: DataFrame,
    kind: str = "in",
    staff: DataFrame | None = None,
    shops: DataFrame | None = None,
    head_office: str = K.HEAD_OFFICE,
) -> DataFrame:
    """Receipt or issue headers; with ``staff`` and ``shops`` the links are checked too."""
    if staff is None:
        return _with_errors(df, stream_header_rules(kind))
    looked, rules = linked_header_rules(df, kind, staff, shops, head_office)
    return _with_errors(looked, rules).select(*df.columns, "errors")


# -- master data -----------------------------------------------------------------------


def customer_rules() -> dict[str, Column]:
    return {
        "name": ~_text("name").rlike(K.RE_CUSTOMER_NAME) | (F.length(_text("name")) > 10),
        "code": _bad_if_filled("code", K.RE_CODE),
        "telephone": _filled("telephone") & (_bad("telephone", K.RE_TELEPHONE) | _too_long("telephone", 11)),
        "address": _too_long("address"),
        "note": _too_long("note"),
    }


def validate_customer(df: DataFrame) -> DataFrame:
    return _with_errors(df, customer_rules())


def product_rules(strict: bool = False) -> dict[str, Column]:
    """``strict`` adds the digit and size-pair patterns the entry form also checks."""
    name_len = F.length(_text("name"))
    rules = {
        "name": (name_len < 2) | (name_len > 30),
        "barcode": _too_long("barcode", 20),
        "size": _too_long("size", 20),
        "category": F.col("category_id").isNull(),
        "note": _too_long("note"),
    }
    if strict:
        rules["name"] = rules["name"] | _bad("name", K.RE_PRODUCT_NAME)
        rules["barcode"] = rules["barcode"] | _bad_if_filled("barcode", K.RE_BARCODE)
        rules["size"] = rules["size"] | _bad_if_filled("size", K.RE_SIZE)
    return rules


def validate_product(df: DataFrame, strict: bool = False) -> DataFrame:
    return _with_errors(df, product_rules(strict))


def remit_rules() -> dict[str, Column]:
    return {
        "supplier": F.coalesce(~F.col("supplier").isin(*K.SUPPLIERS), F.lit(True)),
        "amount": _bad("amount", K.RE_AMOUNT),
        "date": F.col("date").isNull(),
        "note": _too_long("note"),
    }


def validate_remit(df: DataFrame, staff: DataFrame) -> DataFrame:
    """Remittances; the sender must be current staff (level under 99)."""
    levels = staff.select(F.col("id").alias("_sid"), F.col("level").alias("_level"))
    df = df.join(levels, F.col("staff_id") == F.col("_sid"), "left")
    gone = F.coalesce(F.col("_level") >= K.LEVEL_LEFT, F.lit(True))
    return _with_errors(df, {**remit_rules(), "staff": gone}).drop("_sid", "_level")
