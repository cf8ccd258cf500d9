"""Exact money arithmetic.

Amounts are DECIMAL at the API. Inside aggregates they travel as BIGINT cents: sums of
longs stay in generated code, are exact, and do not depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


def cents(amount: Column | str) -> Column:
    """DECIMAL(p,2) -> BIGINT cents."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return (amount * 100).cast("bigint")


def money(value: Column) -> Column:
    """Integral cents -> DECIMAL(20,2)."""
    return (value.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def line_cents(quantity: Column | str, price: Column | str) -> Column:
    quantity = F.col(quantity) if isinstance(quantity, str) else quantity
    return quantity.cast("bigint") * cents(price)


def line_amount(quantity: Column | str, price: Column | str) -> Column:
    """``quantity * price`` of one line."""
    return money(line_cents(quantity, price))


def _div(n: Column, d: Column) -> Column:
    """Integer quotient, truncated; NULL on a zero divisor."""
    return F.call_function("div", n, F.nullif(d, F.lit(0).cast("bigint")))


def half_even_div(n: Column, d: Column) -> Column:
    """``n / d`` of two BIGINTs rounded half to even, in integer arithmetic."""
    sign = F.signum(n).cast("bigint") * F.signum(d).cast("bigint")
    n, d = F.abs(n), F.abs(d)
    q, r = _div(n, d), n % F.nullif(d, F.lit(0).cast("bigint"))
    up = (r * 2 > d) | ((r * 2 == d) & (q % 2 == 1))
    return sign * (q + F.when(up, 1).otherwise(0))


def mean_whole(n: Column, d: Column) -> Column:
    """Whole-cent part of the mean ``n / d``."""
    return _div(n, d)


def mean_millionths(n: Column, d: Column) -> Column:
    """Rest of the mean below one cent, in millionths of a cent."""
    return _div((n % F.nullif(d, F.lit(0).cast("bigint"))) * 1_000_000, d)


def share_of_cost(quantity: Column, paid_cents: Column, received: Column) -> Column:
    """``quantity * paid_cents / received``, in cents, exact up to one rounding at a millionth of a cent.

    The whole cents of the mean are multiplied as integers; only the rest is divided, after it
    was multiplied, so the rounding does not grow with the quantity.
    """
    wide = quantity.cast("decimal(19,0)")
    whole = wide * _div(paid_cents, received).cast("decimal(19,0)")
    rest = wide * (paid_cents % F.nullif(received, F.lit(0).cast("bigint"))).cast("decimal(19,0)")
    return (whole.cast("decimal(38,6)") + (rest / received.cast("decimal(19,0)")).cast("decimal(38,6)")).cast("decimal(38,6)")


def half_up_cents(value: Column) -> Column:
    """Whole cents of an amount in cents, rounded half away from zero."""
    return F.round(value, 0).cast("bigint")


def round_half_up(x: Column, digits: int = 2) -> Column:
    return F.round(x, digits)


def round_half_even(x: Column, digits: int = 2) -> Column:
    return F.bround(x, digits)
