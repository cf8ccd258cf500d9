"""Row predicates shared by searches and role rules."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions.text import icontains


def visible(prefix: str = "") -> Column:
    return ~F.col(f"{prefix}hidden")


def all_of(*tests: Column | None) -> Column:
    out = F.lit(True)
    for test in tests:
        if test is not None:
            out = out & test
    return out


# -- what a staff member may see -------------------------------------------------------


def orders_in_scope(level: int, shop_id: int, requested: int | None = None, everything: bool = False) -> Column:
    """The orders a quick list shows: all shops for levels under 5, else the own shop."""
    if everything or level < 5:
        return F.lit(True)
    return F.col("shop_id") == F.lit(requested if requested is not None else shop_id)


def editable_orders(level: int, shop_id: int) -> Column:
    """Orders of the own shop, for levels up to 5 except store keepers (3)."""
    if level > 5 or level == 3:
        return F.lit(False)
    return F.col("shop_id") == F.lit(shop_id)


def sees_depots(level: int) -> bool:
    return level < 5


def dashboard_days(level: int, days: int, wide: bool = False) -> int:
    """The asked span, refused when it is over the cap of the level."""
    cap = K.DASHBOARD_MAX_DAYS_WIDE if wide else K.DASHBOARD_MAX_DAYS
    if level > 5 and days > cap:
        raise ValueError(f"at most {cap} days")
    return days


# -- order search ----------------------------------------------------------------------


def order_period(as_of: date, s_date: date | None = None, e_date: date | None = None) -> tuple[date, date]:
    """The first day of a search and the day at whose midnight it ends."""
    return s_date or as_of - timedelta(days=K.LOOKBACK_DEFAULT_DAYS), (e_date or as_of) + timedelta(days=1)


def order_filter(
    *,
    as_of: date,
    shop_id: int | None = None,
    code: str = "",
    customer_id: int | None = None,
    staff_id: int | None = None,
    hidden: bool = False,
    note: str = "",
    s_date: date | None = None,
    e_date: date | None = None,
) -> Column:
    """All order search fields AND-ed.

    The code and note tests apply even to an empty text, so orders without a code or a
    note never match. The day after ``e_date`` is included at midnight.
    """
    start, end = order_period(as_of, s_date, e_date)
    return all_of(
        None if shop_id is None else F.col("shop_id") == shop_id,
        icontains(F.col("code"), code),
        None if customer_id is None else F.col("customer_id") == customer_id,
        None if staff_id is None else F.col("staff_id") == staff_id,
        F.col("hidden") if hidden else visible(),
        icontains(F.col("note"), note),
        F.col("date") >= F.lit(str(start)).cast("timestamp_ntz"),
        F.col("date") <= F.lit(str(end)).cast("timestamp_ntz"),
    )
