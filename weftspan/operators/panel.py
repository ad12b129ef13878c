"""The monthly payroll panel: flags, checks and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspan.operators.release_rows import national
from weftspan.plans.ranking import top_per_group
from weftspan.sources import fixed_values as V

KEYS = ["data_month", "measure", "age_band", "gender", "industry", "state"]


def panel_from_flows(flows: DataFrame) -> DataFrame:
    """National, gender, industry and state rows from flow counts.

    flows(data_month, age_band, gender, industry, state, new, ceased, rejoined)
    is summed over four grouping sets in one shuffle. National rows carry all
    four measures, gender rows the three gross ones, the others net only.
    """
    base = flows.groupBy("data_month", "age_band", "gender", "industry", "state").agg(
        *[F.sum(c).alias(c) for c in ("new", "ceased", "rejoined")]
    )
    d = {c: F.col(c) for c in ("data_month", "age_band", "gender", "industry", "state")}
    sets = [
        [d["data_month"], d["age_band"]],
        [d["data_month"], d["age_band"], d["gender"]],
        [d["data_month"], d["age_band"], d["industry"]],
        [d["data_month"], d["age_band"], d["state"]],
    ]
    summed = base.groupingSets(sets, *d.values()).agg(
        F.sum("new").alias("new_subscribers"),
        F.sum("ceased").alias("ceased"),
        F.sum("rejoined").alias("rejoined"),
        F.grouping("gender").alias("_g"),
        F.grouping("industry").alias("_i"),
        F.grouping("state").alias("_s"),
    )
    net = F.col("new_subscribers") - F.col("ceased") + F.col("rejoined")

    def entry(measure: str, value: Column) -> Column:
        return F.struct(F.lit(measure).alias("measure"), value.cast("bigint").alias("value"))

    gross = [entry(m, F.col(m)) for m in V.GROSS_MEASURES]
    only_net = F.array(entry("net_payroll", net))
    total = (F.col("_g") == 1) & (F.col("_i") == 1) & (F.col("_s") == 1)
    by_gender = F.col("_g") == 0
    entries = (
        F.when(total, F.array(*gross, entry("net_payroll", net)))
        .when(by_gender, F.array(*gross))
        .otherwise(only_net)
    )
    return summed.select(
        "data_month", "age_band", "gender", "industry", "state", F.inline(entries)
    ).select(*KEYS, "value")


def with_series_break(panel: DataFrame, before: str = V.SERIES_BREAK_BEFORE) -> DataFrame:
    return panel.withColumn("series_break_flag", F.col("data_month") < before)


def sorted_panel(panel: DataFrame) -> DataFrame:
    return panel.orderBy("data_month", "measure", "age_band", "gender", "state", "industry")


def duplicate_keys(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys met more than once; nulls in a key are equal to each other."""
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def negative_gross(panel: DataFrame) -> DataFrame:
    return panel.filter((F.col("measure") != "net_payroll") & (F.col("value") < 0))


def check_panel(panel: DataFrame) -> DataFrame:
    """The panel unchanged; an error for repeated keys or negative gross flows."""
    for name, bad in (("duplicate keys", duplicate_keys(panel)), ("negative gross", negative_gross(panel))):
        sample = bad.limit(10).collect()
        if sample:
            raise ValueError(f"{name}: {[tuple(r) for r in sample]}")
    return panel


def calendar_gaps(panel: DataFrame) -> DataFrame:
    """Months between the first and last national month that have no rows."""
    months = national(panel).select("data_month").distinct()
    day = F.to_date(F.concat("data_month", F.lit("-01")))
    span = months.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    calendar = span.select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d")
    ).select(F.date_format("d", "yyyy-MM").alias("data_month"))
    return calendar.join(months, "data_month", "left_anti")


def _month_totals(panel: DataFrame) -> DataFrame:
    net = national(panel).filter(F.col("measure") == "net_payroll")
    young = F.col("age_band").isin(V.YOUNG_BANDS)
    return net.groupBy("data_month").agg(
        F.sum("value").alias("net"),
        F.coalesce(F.sum(F.when(young, F.col("value"))), F.lit(0)).alias("young"),
    )


def last_year_summary(panel: DataFrame, months: int = 12) -> DataFrame:
    """Mean monthly net and young share over the latest months with net rows."""
    latest = top_per_group(_month_totals(panel), [], [F.desc("data_month")], months)
    return latest.agg(
        F.avg("net").alias("net_mean"),
        (F.sum("young") / F.sum("net")).alias("young_share"),
        F.count(F.lit(1)).alias("n_months"),
    )


def sanity_counts(panel: DataFrame, low_months: Sequence[str] = ("2020-04", "2020-05")) -> DataFrame:
    """Months, negative cells and distinct members per dimension, in one row."""
    nat = F.col("gender").isNull() & F.col("industry").isNull() & F.col("state").isNull()
    net = nat & (F.col("measure") == "net_payroll") & (F.col("value") < 0)

    def months(condition: Column) -> Column:
        return F.count_distinct(F.when(condition, F.col("data_month")))

    return panel.agg(
        F.min(F.when(nat, F.col("data_month"))).alias("months_first"),
        F.max(F.when(nat, F.col("data_month"))).alias("months_last"),
        months(nat).alias("n_months"),
        months(F.col("gender").isNotNull()).alias("months_gender"),
        months(F.col("state").isNotNull()).alias("months_state"),
        months(F.col("industry").isNotNull()).alias("months_industry"),
        F.count_distinct("state").alias("n_states"),
        F.count_distinct("industry").alias("n_industries"),
        F.count_if(net & F.col("data_month").isin(list(low_months))).alias("negative_low_cells"),
        F.count_if(net & (F.col("age_band") == ">35")).alias("negative_over35"),
    )


def gender_vs_national(panel: DataFrame) -> DataFrame:
    """Cells where the genders do not add up to the national value.

    Gender and national rows meet in one group: no join, no second scan.
    """
    gross = panel.filter(
        (F.col("measure") != "net_payroll") & F.col("industry").isNull() & F.col("state").isNull()
    )
    has_gender = F.col("gender").isNotNull()
    return (
        gross.groupBy("data_month", "measure", "age_band")
        .agg(
            F.sum(F.when(has_gender, F.col("value"))).alias("gender_sum"),
            F.sum(F.when(~has_gender, F.col("value"))).alias("national_value"),
        )
        .withColumn("matches", F.col("gender_sum").eqNullSafe(F.col("national_value")))
    )


def flow_identity(panel: DataFrame) -> DataFrame:
    """Measures side by side per month and band, with new - ceased + rejoined - net."""
    wide = (
        national(panel)
        .groupBy("data_month", "age_band")
        .pivot("measure", V.FLOW_MEASURES)
        .agg(F.sum("value"))
    )
    return wide.withColumn(
        "residual",
        F.col("new_subscribers") - F.col("ceased") + F.col("rejoined") - F.col("net_payroll"),
    )


def trailing_mean(
    panel: DataFrame,
    rows: int = 6,
    start: str = V.SERIES_BREAK_BEFORE,
    provisional_from: str = V.PROVISIONAL_FROM,
) -> DataFrame:
    """Trailing mean of net flows by band in millions, over rows (not months),
    null until the frame is full; recent months are marked provisional.

    The panel has one national row per month and band, so a window holds one
    band's months only.
    """
    net = national(panel).filter(
        (F.col("measure") == "net_payroll") & (F.col("data_month") >= start)
    )
    frame = Window.partitionBy("age_band").orderBy("data_month").rowsBetween(1 - rows, 0)
    full = F.count("value").over(frame) == rows
    return net.select(
        "data_month",
        "age_band",
        "value",
        (F.when(full, F.avg("value").over(frame)) / 1e6).alias("mean_m"),
        (F.col("data_month") >= provisional_from).alias("provisional"),
    )


def latest_values(trend: DataFrame, series: str = "age_band", value: str = "mean_m") -> DataFrame:
    """Last non-null value of each series."""
    known = F.when(F.col(value).isNotNull(), F.col("data_month"))
    return trend.groupBy(series).agg(
        F.max_by(value, known).alias("latest"), F.max(known).alias("data_month")
    )


def densify(cells: DataFrame, a: str, b: str, value: str, spine_a: DataFrame, spine_b: DataFrame) -> DataFrame:
    """Balanced grid of two key lists with zero where no cell exists.

    Each a-key is paired with the list of b-keys held in its row.
    """
    listed = F.sort_array(F.collect_set(b))
    grid = spine_a.select(a).distinct().withColumn(
        "_all", spine_b.agg(listed).scalar()
    ).select(a, F.explode("_all").alias(b))
    return grid.join(cells.select(a, b, value), [a, b], "left").withColumn(
        value, F.coalesce(value, F.lit(0))
    )
