"""Ranking without moving a whole table, or a hot group, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspan.plans.storage import materialise

SALTS = 64
HASH_DIGITS = 4
BLOCK_PAGES, BLOCK_LEVELS = 4_096, 2
#: Bits of ``monotonically_increasing_id`` that count within a partition.
PLACE_BITS = 33


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | str,
    rank: str | None = None,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """First ``k`` rows of each group; ``k`` is a number or a column of the group.

    A row among the first k of its group is among the first k of any part of
    it, so each group is cut in parts first and a hot group never sorts in one
    task. ``order`` must be total within a group for a repeatable answer.
    """
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    name = rank or "_rank"
    if not keys and not isinstance(k, str):
        first = df.orderBy(*order).limit(k)
        ranked = first.withColumn(name, F.row_number().over(Window.orderBy(*order)))
        return ranked if rank else ranked.drop(name)
    part = F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(SALTS))
    cut = (
        df.withColumn("_part", part)
        .withColumn(
            name,
            F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)),
        )
        .filter(F.col(name) <= limit)
        .drop("_part", name)
    )
    ranked = cut.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(name) <= limit)
    return ranked if rank else ranked.drop(name)


def hash_sequence(
    df: DataFrame,
    digest: Column,
    name: str,
    tie: Sequence[str] = (),
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Number all rows from 1 in the order of a hexadecimal digest.

    The leading digits cut the table into 16**digits even ranges. Each range is
    numbered on its own and shifted by the sizes of the ranges before it; only
    the table of range sizes, whose length is fixed, is ordered as a whole.
    """
    keyed = df.withColumn("_digest", digest).withColumn(
        "_range", F.substring("_digest", 1, digits)
    )
    sizes = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_range").orderBy("_digest", *tie)
    return (
        keyed.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_place") + F.col("_offset")).cast("long"))
        .drop("_digest", "_range", "_place", "_offset")
    )


def ordered_sequence(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows from 1 in ``order``, which should be total.

    The table is sorted by ranges and written; a row's number is its place in its
    range and the sizes of the ranges before. Only one row per range is ordered in
    one task.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(cut.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    sizes = placed.groupBy(F.shiftright("_at", PLACE_BITS).alias("_range")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.withColumn("_range", F.shiftright("_at", PLACE_BITS))
        .join(F.broadcast(shifts), "_range")
        .withColumn(name, (F.col("_at") - F.col("_first") + F.col("_offset") + 1).cast("long"))
        .drop("_at", "_range", "_first", "_offset")
    )


def carry_forward(
    df: DataFrame,
    source: Sequence[str],
    page: str,
    place: Sequence[str],
    states: Sequence[str],
    inclusive: bool = True,
) -> DataFrame:
    """Last non-null value of each state column up to (or before) every row.

    Rows are ordered by (page, *place) within a source. The walk is done per
    page, and the state left by each page is handed on from page to page, then
    from block to block of pages (``page`` is a whole number), so that no window
    holds all pages of a long source.
    """
    end = 0 if inclusive else -1
    rows = Window.partitionBy(*source, page).orderBy(*place).rowsBetween(
        Window.unboundedPreceding, end
    )
    at = F.struct(*place)
    handed = _handed_on(_left_behind(df, [*source, page], at, states), source, page, states, BLOCK_LEVELS)
    walked = df.select(
        "*", *[F.last(s, ignorenulls=True).over(rows).alias(f"_at_{s}") for s in states]
    ).join(handed, [*source, page])
    kept = [c for c in df.columns if c not in states]
    return walked.select(
        *kept,
        *[F.coalesce(f"_at_{s}", f"_in_{s}").alias(s) for s in states],
    )


def _left_behind(df: DataFrame, keys: Sequence[str], at: Column, states: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max_by(F.col(s), F.when(F.col(s).isNotNull(), at)).alias(s) for s in states])


def _handed_on(left: DataFrame, source: Sequence[str], page: str, states: Sequence[str], levels: int) -> DataFrame:
    """State before each page, from the states that pages leave behind."""
    keys, block = list(source), f"_block{levels}"
    if levels:
        left = left.withColumn(block, F.floor(F.col(page) / BLOCK_PAGES))
        keys.append(block)
    earlier = Window.partitionBy(*keys).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    within = left.select(
        *keys, page, *[F.last(s, ignorenulls=True).over(earlier).alias(f"_in_{s}") for s in states]
    )
    if not levels:
        return within
    blocks = _left_behind(left, keys, F.col(page), states)
    before = _handed_on(blocks, source, block, states, levels - 1).select(
        *keys, *[F.col(f"_in_{s}").alias(f"_before_{s}") for s in states]
    )
    return within.join(before, keys).select(
        *source, page, *[F.coalesce(f"_in_{s}", f"_before_{s}").alias(f"_in_{s}") for s in states]
    )
