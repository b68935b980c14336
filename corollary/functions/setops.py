"""Sets of rows as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*a.columns), a.columns, "left_anti")


def contains(a: DataFrame, b: DataFrame) -> bool:
    """Whether every row of b is in a."""
    return difference(b, a).isEmpty()


def equal(a: DataFrame, b: DataFrame) -> bool:
    return contains(a, b) and contains(b, a)
