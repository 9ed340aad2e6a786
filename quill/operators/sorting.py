"""Sorts, limits, top-k and set helpers.
Every limit is a TakeOrdered (per-partition top-n then a bounded merge)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import feature_columns  # noqa: F401  (U3)


def head(df: DataFrame, n: int, order, ascending: bool = True) -> DataFrame:
    """First (or, descending, last) ``n`` rows of an explicit order."""
    order = [order] if isinstance(order, str) else list(order)
    cols = [F.asc_nulls_first(c) if ascending else F.desc_nulls_last(c) for c in order]
    return df.orderBy(*cols).limit(n)


def top_values(df: DataFrame, col: str, n: int, key: str | None = None) -> DataFrame:
    """The ``n`` largest values of a column (key as tie-break)."""
    order = [F.desc(col)] + ([F.asc(key)] if key else [])
    return df.where(F.col(col).isNotNull()).orderBy(*order).limit(n)


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present in both sets."""
    return a.select(key).intersect(b.select(key))


def ordered_intersect(a, b):
    """Array intersection keeping the first array's order (deduplicated)."""
    return F.array_intersect(a, b)
