"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

SMALL_ROWS = 100_000


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """True when at most ``max_rows`` rows exist; never counts beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark an aggregate for broadcast if, and only if, it proves small.

    The frame is kept while it is counted, so the check and the join share one
    computation. A larger frame comes back without a hint: the join is then a
    shuffle join, which adaptive execution splits on skewed keys.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if is_small(kept, max_rows):
        return F.broadcast(kept)
    kept.unpersist()
    return df


def lookup_join(
    rows: DataFrame,
    dimension: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Join a dimension onto rows, broadcasting the dimension if it is small."""
    return rows.join(small_side(dimension, max_rows), on=on, how=how)


def bounded_map(spark, rows, schema) -> DataFrame:
    """Dimension map given by the caller as literal rows (bounded by nature)."""
    return F.broadcast(spark.createDataFrame(rows, schema))
