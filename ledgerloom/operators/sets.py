"""Comparing a submitted list of ids with the stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ids_kept(stored: DataFrame, submitted: DataFrame, key: str = "id") -> DataFrame:
    return stored.select(key).intersect(submitted.select(key))


def ids_removed(stored: DataFrame, submitted: DataFrame, key: str = "id") -> DataFrame:
    """Stored ids the list no longer names."""
    return stored.select(key).join(submitted.select(key).distinct(), key, "left_anti")


def ids_added(stored: DataFrame, submitted: DataFrame, key: str = "id") -> DataFrame:
    """Listed ids that are not stored."""
    return submitted.select(key).distinct().join(stored.select(key), key, "left_anti")
