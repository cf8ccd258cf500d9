"""Code -> label expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import constants as K


def _lookup(code: Column, labels: Mapping) -> Column:
    out = F.lit(None).cast("string")
    for key, label in labels.items():
        out = F.when(code == F.lit(key), label).otherwise(out)
    return out


def supplier_label(code: Column) -> Column:
    return _lookup(code, K.SUPPLIERS)


def sex_label(code: Column) -> Column:
    return _lookup(code, K.SEXES)


def marital_label(flag: Column) -> Column:
    return _lookup(flag, K.MARITAL)


def level_label(level: Column) -> Column:
    return _lookup(level, K.LEVELS)


def status_label(hidden: Column) -> Column:
    return F.when(hidden, K.STATUS_DELETED).otherwise(K.STATUS_ACTIVE)


def staff_label(level: Column, name: Column) -> Column:
    return F.concat_ws(" ", level_label(level), name)


def customer_label(name: Column, code: Column, telephone: Column, id_: Column) -> Column:
    from ledgerloom.functions.text import pipe_row

    return pipe_row(name, code, telephone, id_)


def category_label(name: Column, parent_name: Column) -> Column:
    """``parent-name``, or the bare name of a root."""
    return F.concat_ws("-", parent_name, name)


def product_label(name: Column, barcode: Column, id_: Column) -> Column:
    from ledgerloom.functions.text import pipe_row

    return pipe_row(name, barcode, id_)
