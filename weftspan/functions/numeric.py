"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspan.plans.sizing import small_side

# Rank brackets of the exact median; the sketch error is 1 / MEDIAN_ACCURACY.
MEDIAN_ACCURACY = 100_000
MEDIAN_MARGIN = 2.0 / MEDIAN_ACCURACY


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_fill(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer text is kept whole (``lpad`` would cut it)."""
    text = col(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null."""
    return F.when(b != 0, a / b)


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Σxw / Σw over rows where x is known."""
    x, w = col(x), col(w)
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def sum_where(condition: Column, x: Column | str) -> Column:
    """Sum of x over rows meeting a condition; 0 over no rows."""
    return F.coalesce(F.sum(F.when(condition, col(x))), F.lit(0.0))


def share_where(condition: Column, w: Column | str) -> Column:
    return ratio(sum_where(condition, w), F.sum(col(w)))


def grand_total(c: Column | str) -> Column:
    """Total over all rows of a grouped frame, kept beside each row.

    For frames with one row per value of a classification: the rows that meet
    in one task are groups, and the table below is read once, where a
    subquery for the total would read it again.
    """
    return F.sum(col(c)).over(Window.partitionBy(F.lit(0)))


def asinh(c: Column | str) -> Column:
    """Inverse hyperbolic sine, odd by construction so that large negative
    values keep their digits."""
    x = F.abs(col(c).cast("double"))
    return F.signum(col(c).cast("double")) * F.log(x + F.sqrt(x * x + 1.0))


def group_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact interpolated median per group, whatever the group size.

    A mergeable quantile sketch brackets the middle of each group; only the
    values inside the bracket are then counted and ordered, so a group that
    holds most of the rows is never gathered.
    """
    known = df.filter(F.col(value).isNotNull())
    rank_at = [0.5 - MEDIAN_MARGIN, 0.5 + MEDIAN_MARGIN]
    sketch = known.groupBy(*keys).agg(
        F.percentile_approx(value, rank_at, MEDIAN_ACCURACY).alias("_bracket"),
        F.count(F.lit(1)).alias("_n"),
    )
    placed = known.select(*keys, value).join(small_side(sketch), keys)
    low, high = F.col("_bracket")[0], F.col("_bracket")[1]
    inside = F.when(F.col(value).between(low, high), F.col(value))
    # values below the bracket share one null key; those above are not needed
    counted = (
        placed.filter(F.col(value) <= high)
        .groupBy(*keys, "_n", inside.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    reached = counted.withColumn(
        "_to", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_from", F.col("_to") - F.col("_c"))
    lower = F.floor((F.col("_n") + 1) / 2)
    upper = F.ceil((F.col("_n") + 1) / 2)

    def holds(position: Column) -> Column:
        return (F.col("_from") < position) & (position <= F.col("_to"))

    return reached.groupBy(*keys).agg(
        (
            (F.max(F.when(holds(lower), F.col("_v"))) + F.max(F.when(holds(upper), F.col("_v"))))
            / 2.0
        ).alias(name)
    )
