"""Survey microdata: derived columns, weights, index join and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.functions.numeric import grand_total, sum_where, zero_fill
from weftspan.operators.contracts import ContractError, stop_unless
from weftspan.plans.sizing import lookup_join
from weftspan.sources.fixed_values import (
    BENEFIT_CODES_FALSE,
    BENEFIT_CODES_TRUE,
    EMPLOYED_STATUS,
    MIN_COVERAGE,
)

INDEX_COLUMNS = ["n_tasks", "alpha", "beta", "zeta"]


def employed(workers: DataFrame, codes: Sequence[int] = EMPLOYED_STATUS) -> DataFrame:
    return workers.filter(F.col("status_code").isin(list(codes)))


def survey_weight() -> Column:
    """Persons per record: multiplier over 100, or 200 if the sub-sample counts
    differ, over the number of quarters."""
    base = F.when(F.col("nss") == F.col("nsc"), F.col("mult") / 100).otherwise(
        F.col("mult") / 200
    )
    return base / F.col("no_qtr")


def simple_weight() -> Column:
    return F.col("mult") / F.col("no_qtr")


def monthly_earnings() -> Column:
    zero = F.lit(0.0)
    return F.coalesce(F.col("earnings_regular"), zero) + F.coalesce(F.col("earnings_self"), zero)


def formal_proxy() -> Column:
    """True, false or null (not known)."""
    c = F.col("ss_benefit_code")
    return (
        F.when(c.isin(BENEFIT_CODES_TRUE), F.lit(True))
        .when(c.isin(BENEFIT_CODES_FALSE), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def division_of(nic5: Column | str = "nic5") -> Column:
    """Two-digit industry division of a five-digit code (leading zeros restored)."""
    return F.substring(zero_fill(nic5, 5), 1, 2)


def derive_workers(raw: DataFrame) -> DataFrame:
    """Employed records with group key, weight, earnings and formality proxy."""
    return employed(raw).select(
        "*",
        zero_fill("nco3_raw", 3).alias("group3"),
        survey_weight().alias("weight"),
        monthly_earnings().alias("monthly_earnings"),
        formal_proxy().alias("formal_proxy"),
    )


def worker_faults(workers: DataFrame) -> DataFrame:
    """Counts of rows outside the stated domains, in one pass."""

    def bad(ok: Column) -> Column:
        return F.count_if(~F.coalesce(ok, F.lit(False)))

    return workers.agg(
        bad(F.col("sex_code").isin(1, 2, 3)).alias("bad_sex"),
        bad(F.col("age").between(0, 120)).alias("bad_age"),
        bad(F.col("sector_code").isin(1, 2)).alias("bad_sector"),
        bad(F.col("weight") > 0).alias("bad_weight"),
    )


def assert_workers(workers: DataFrame) -> DataFrame:
    faults = {k: n for k, n in worker_faults(workers).first().asDict().items() if n}
    if faults:
        raise ContractError(f"worker rows outside their domains: {faults}")
    return workers


def attach_index(workers: DataFrame, index: DataFrame, key: str = "group3") -> DataFrame:
    """Left join of the group index; it is broadcast only after a size check,
    so worker rows are not shuffled and hot groups do no harm."""
    columns = [c for c in INDEX_COLUMNS if c in index.columns]
    return lookup_join(workers, index.select(key, *columns), key, "left")


def match_coverage(merged: DataFrame) -> DataFrame:
    """Weight with an index value over all weight."""
    return merged.agg(
        F.count(F.lit(1)).alias("n_workers"),
        F.sum("weight").alias("weight_total"),
        sum_where(F.col("beta").isNotNull(), "weight").alias("weight_matched"),
    ).withColumn("coverage", F.col("weight_matched") / F.col("weight_total"))


def unmatched_groups(merged: DataFrame, key: str = "group3") -> DataFrame:
    """Groups without an index and their share of all weight.

    One grouped pass serves both the groups and the total.
    """
    by_group = merged.groupBy(key).agg(
        F.sum("weight").alias("weight"),
        sum_where(F.col("beta").isNull(), "weight").alias("weight_unmatched"),
    )
    shares = by_group.withColumn(
        "emp_share", F.col("weight_unmatched") / grand_total("weight")
    )
    return shares.filter(F.col("weight_unmatched") > 0).select(
        key, F.col("weight_unmatched").alias("weight"), "emp_share"
    )


def project_index(
    workers: DataFrame, index: DataFrame, survey_year: str, minimum: float = MIN_COVERAGE
) -> DataFrame:
    """Workers with index, after the coverage gate; stops below the minimum."""
    merged = attach_index(workers, index)
    stop_unless(match_coverage(merged), "coverage", minimum=minimum)
    return merged.withColumn("preliminary", F.lit(True)).withColumn(
        "survey_year", F.lit(survey_year)
    )


def employment_shares(workers: DataFrame, weight: str = "weight") -> DataFrame:
    """Weight and share of all weight by group, with the division of the group."""
    groups = workers.groupBy("group3").agg(F.sum(weight).alias("w"))
    return groups.select(
        "group3",
        "w",
        (F.col("w") / grand_total("w")).alias("share"),
        F.substring("group3", 1, 1).alias("division"),
    )


def headcount(workers: DataFrame) -> DataFrame:
    """Millions of workers by group and industry division; null division kept."""
    return workers.groupBy(
        "group3", division_of().try_cast("int").alias("nic_div")
    ).agg((F.sum("weight") / 1e6).alias("workers_m"))
