"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast side has at most.
BROADCAST_ROWS = 200_000


def fits(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df has no more rows than a broadcast side may have; no more than that are counted."""
    most = BROADCAST_ROWS if rows is None else rows
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a hint to broadcast it if it fits; else as it is, and joins on it shuffle."""
    return F.broadcast(df) if fits(df, rows) else df
