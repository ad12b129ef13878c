"""Weighted cuts over the merged microdata.

Every cut is one grouped aggregate with partial sums before its shuffle. Cuts
over overlapping maps first reduce worker rows to sums per industry division,
so the map multiplies about a hundred rows, not the microdata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspan.functions.numeric import grand_total, group_median, ratio, share_where, sum_where, weighted_mean
from weftspan.operators.index import reweighted
from weftspan.operators.survey import division_of
from weftspan.plans.sizing import small_side
from weftspan.sources import fixed_values as V
from weftspan.sources.maps import in_range, in_sets

MILLION = 1e6


def scored(merged: DataFrame) -> DataFrame:
    return merged.filter(F.col("beta").isNotNull())


def is_high(score: Column | str = "beta") -> Column:
    return (F.col(score) if isinstance(score, str) else score) >= V.HIGH_SCORE


def is_white_collar(group: str = "group3", start: int = 1) -> Column:
    """Divisions 1 to 4; ``start`` is where the division digit stands."""
    return F.substring(group, start, 1).isin(V.WHITE_COLLAR)


def wage_bill() -> Column:
    """Earnings times weight, earners only."""
    return F.when(F.col("monthly_earnings") > 0, F.col("monthly_earnings") * F.col("weight"))


def exposure_summary(merged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean score and share of weight at or above the high score."""
    return scored(merged).groupBy(*keys).agg(
        weighted_mean("beta", "weight").alias("mean_beta"),
        share_where(is_high(), "weight").alias("share_high"),
        F.sum("weight").alias("weight"),
    )


def exposure_with_coverage(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, high share and match coverage by key, from one pass."""
    return merged.groupBy(*keys).agg(
        weighted_mean("beta", "weight").alias("mean_beta"),
        ratio(
            sum_where(is_high(), "weight"), sum_where(F.col("beta").isNotNull(), "weight")
        ).alias("share_high"),
        ratio(
            sum_where(F.col("beta").isNotNull(), "weight"), F.sum("weight")
        ).alias("coverage"),
        F.sum("weight").alias("weight"),
    )


def wage_bill_share(merged: DataFrame) -> DataFrame:
    """High-score share of people and of the wage bill."""
    return scored(merged).agg(
        share_where(is_high(), "weight").alias("headcount_share"),
        ratio(sum_where(is_high(), wage_bill()), F.sum(wage_bill())).alias("wage_bill_share"),
    )


def _age_band(bands: Sequence[tuple[int, int]]) -> Column:
    return in_range(F.col("age"), [(f"{a}-{b}", a, b + 1) for a, b in bands])


def entry_rung(
    merged: DataFrame, bands: Sequence[tuple[int, int]] = V.AGE_BANDS, division_at: int = 1
) -> DataFrame:
    """Mean, high share and weight by age band for white-collar and all workers.

    Both segments come from conditional sums over one scan; bands without
    weight give no row.
    """
    wc = F.coalesce(is_white_collar(start=division_at), F.lit(False))
    everyone = F.lit(True)

    def sums(segment: Column) -> Column:
        return F.struct(
            sum_where(segment, F.col("beta") * F.col("weight")).alias("wx"),
            sum_where(segment & is_high(), "weight").alias("hi"),
            sum_where(segment, "weight").alias("w"),
        )

    wide = (
        scored(merged)
        .withColumn("age_band", _age_band(bands))
        .filter(F.col("age_band").isNotNull())
        .groupBy("age_band")
        .agg(sums(wc).alias("white_collar"), sums(everyone).alias("all_workers"))
    )
    entries = [
        F.struct(F.lit(s).alias("segment"), F.col(s).alias("s"))
        for s in ("white_collar", "all_workers")
    ]
    return (
        wide.select("age_band", F.inline(F.array(*entries)))
        .filter(F.col("s.w") != 0)
        .select(
            "age_band",
            "segment",
            (F.col("s.wx") / F.col("s.w")).alias("mean_beta"),
            (F.col("s.hi") / F.col("s.w")).alias("share_hi_exposure"),
            F.col("s.w").alias("emp_weight_share"),
        )
    )


def score_histogram(merged: DataFrame, bins=V.SCORE_BINS) -> DataFrame:
    """Share of weight in percent per half-open score bin; empty bins give 0."""
    df = scored(merged)
    sums = [
        sum_where((F.col("beta") >= low) & (F.col("beta") < high), "weight").alias(f"b{i}")
        for i, (_, low, high) in enumerate(bins)
    ]
    wide = df.agg(*sums, F.sum("weight").alias("total"))
    entries = [
        F.struct(
            F.lit(i).alias("bin_no"),
            F.lit(label).alias("bin"),
            (ratio(F.col(f"b{i}"), F.col("total")) * 100).alias("pct"),
        )
        for i, (label, _, _) in enumerate(bins)
    ]
    return wide.select(F.inline(F.array(*entries)))


def education_cut(merged: DataFrame, sets=V.EDUCATION) -> DataFrame:
    """Share of all weight in percent and mean score by education label."""
    df = scored(merged)
    cells = (
        df.groupBy(in_sets(F.col("edu_code"), sets).alias("education"))
        .agg(F.sum("weight").alias("w"), F.sum(F.col("beta") * F.col("weight")).alias("wx"))
    )
    shares = cells.withColumn("pct", F.col("w") / grand_total("w") * 100)
    return shares.filter(F.col("education").isNotNull()).select(
        "education",
        "pct",
        (F.col("wx") / F.col("w")).alias("mean_beta"),
    )


def gender_by_organised(merged: DataFrame) -> DataFrame:
    """Mean score of men and women, for all and for the organised sector
    (urban with a known benefit)."""
    organised = F.coalesce(
        (F.col("sector_code") == 2) & F.col("formal_proxy"), F.lit(False)
    )
    wide = []
    for name, inside in (("all", F.lit(True)), ("organised", organised)):
        for sex, code in (("men", 1), ("women", 2)):
            here = inside & (F.col("sex_code") == code)
            wide.append(
                ratio(
                    sum_where(here, F.col("beta") * F.col("weight")), sum_where(here, "weight")
                ).alias(f"{name}_{sex}")
            )
    row = scored(merged).agg(*wide)
    entries = [
        F.struct(
            F.lit(name).alias("segment"),
            F.col(f"{name}_men").alias("men"),
            F.col(f"{name}_women").alias("women"),
        )
        for name in ("all", "organised")
    ]
    return row.select(F.inline(F.array(*entries)))


def white_collar_high_by_age(
    merged: DataFrame, bands=V.AGE_BANDS[1:9], division_at: int = 1
) -> DataFrame:
    """High-score share in percent by age within white-collar, and the segment
    average over all ages."""
    cells = (
        scored(merged)
        .filter(is_white_collar(start=division_at))
        .groupBy(_age_band(bands).alias("age_band"))
        .agg(sum_where(is_high(), "weight").alias("hi"), F.sum("weight").alias("w"))
    )
    with_average = cells.withColumn(
        "segment_pct", ratio(grand_total("hi"), grand_total("w")) * 100
    )
    return with_average.filter(F.col("age_band").isNotNull()).select(
        "age_band", (ratio(F.col("hi"), F.col("w")) * 100).alias("hi_pct"), "segment_pct"
    )


def state_ranking(
    merged: DataFrame, top: int = 8, bottom: int = 4, min_share: float = 0.005
) -> DataFrame:
    """Highest and lowest mean scores among states above a share of weight."""
    states = scored(merged).groupBy("state").agg(
        weighted_mean("beta", "weight").alias("mean_beta"), F.sum("weight").alias("w")
    )
    kept = states.withColumn("_share", F.col("w") / grand_total("w")).filter(
        F.col("_share") > min_share
    ).drop("_share")
    # both ends come from the same ranked state rows: one pass over workers
    ends = kept.withColumn(
        "_high", F.row_number().over(Window.orderBy(F.desc("mean_beta"), F.asc("state")))
    ).withColumn("_low", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).cast("int") - F.col("_high") + 1)
    sides = F.filter(
        F.array(
            F.struct(F.lit("top").alias("side"), F.col("_high").alias("place")),
            F.struct(F.lit("bottom").alias("side"), F.col("_low").alias("place")),
        ),
        lambda e: e.getField("place") <= F.when(e.getField("side") == "top", top).otherwise(bottom),
    )
    return ends.select("state", "mean_beta", "w", F.inline(sides))


def with_section(merged: DataFrame, sections=V.SECTIONS) -> DataFrame:
    div = division_of().try_cast("int")
    return merged.withColumn("section", in_range(div, sections))


def section_means(merged: DataFrame, min_workers_m: float = 2.0) -> DataFrame:
    """Mean score and millions of workers by section above a headcount."""
    return (
        with_section(scored(merged))
        .filter(F.col("section").isNotNull())
        .groupBy("section")
        .agg(
            weighted_mean("beta", "weight").alias("mean_beta"),
            (F.sum("weight") / MILLION).alias("workers_m"),
        )
        .filter(F.col("workers_m") > min_workers_m)
    )


def top_groups(merged: DataFrame, n: int = 10, min_workers_m: float = 0.3) -> DataFrame:
    """Groups with the highest mean score among those large enough."""
    groups = (
        scored(merged)
        .groupBy("group3")
        .agg(
            weighted_mean("beta", "weight").alias("mean_beta"),
            (F.sum("weight") / MILLION).alias("workers_m"),
        )
        .filter(F.col("workers_m") >= min_workers_m)
    )
    return groups.orderBy(F.desc("mean_beta"), "group3").limit(n)


def section_wage_bill(
    merged: DataFrame, n: int = 10, unit: float = 1e10, min_units: float = 0.5
) -> DataFrame:
    """Wage bill per section, its high-score part in percent, exposed workers,
    for the n sections with the largest part; with the economy-wide average."""
    earners = with_section(scored(merged).filter(F.col("monthly_earnings") > 0)).filter(
        F.col("section").isNotNull()
    )
    cells = earners.groupBy("section").agg(
        F.sum(wage_bill()).alias("wb"),
        sum_where(is_high(), wage_bill()).alias("wb_hi"),
        (sum_where(is_high(), "weight") / MILLION).alias("hi_workers_m"),
    )
    economy = ratio(grand_total("wb_hi"), grand_total("wb"))
    return (
        cells.select(
            "section",
            (F.col("wb") / unit).alias("wb_units"),
            (ratio(F.col("wb_hi"), F.col("wb")) * 100).alias("hi_pct"),
            "hi_workers_m",
            (economy * 100).alias("economy_pct"),
        )
        .filter(F.col("wb_units") > min_units)
        .orderBy(F.desc("hi_pct"), "section")
        .limit(n)
    )


def top_index_groups(
    merged: DataFrame, index: DataFrame, n: int = 10, min_tasks: int = 5
) -> DataFrame:
    """Groups with the highest index, any size, that have enough tasks."""
    size = scored(merged).groupBy("group3").agg((F.sum("weight") / MILLION).alias("workers_m"))
    kept = index.filter(F.col("n_tasks") >= min_tasks).select("group3", "beta")
    return size.join(small_side(kept), "group3").orderBy(F.desc("beta"), "group3").limit(n)


def bubble_frame(
    merged: DataFrame,
    index: DataFrame,
    white_collar: bool = False,
    min_tasks: int = 5,
    min_workers_m: float = 0.01,
    division_at: int = 1,
) -> DataFrame:
    """Workers, share of the national wage bill and index per group.

    The white-collar variant keeps fewer groups but the national denominator.
    """
    groups = scored(merged).groupBy("group3").agg(
        (F.sum("weight") / MILLION).alias("workers_m"), F.sum(wage_bill()).alias("wb")
    )
    groups = groups.withColumn("wb_pct", F.col("wb") / grand_total("wb") * 100)
    kept = groups.filter(is_white_collar(start=division_at)) if white_collar else groups
    scores = index.filter(F.col("n_tasks") >= min_tasks).select("group3", "beta")
    return (
        kept.join(small_side(scores), "group3")
        .filter(F.col("workers_m") > min_workers_m)
        .select(
            "group3",
            "workers_m",
            F.coalesce("wb_pct", F.lit(0.0)).alias("wb_pct"),
            "beta",
        )
    )


def division_sums(merged: DataFrame, division_at: int = 1) -> DataFrame:
    """Weight sums per industry division, from which head and activity
    statistics follow without touching worker rows again."""
    df = scored(merged).filter(F.col("nic5").isNotNull())
    x, w = F.col("beta"), F.col("weight")
    return df.groupBy(division_of().alias("nic2")).agg(
        F.sum(w).alias("w"),
        F.sum(x * w).alias("wx"),
        F.sum(x * x * w).alias("wxx"),
        sum_where(is_high(), w).alias("w_hi"),
        sum_where(is_white_collar(start=division_at), w).alias("w_wc"),
    )


def activity_bridge(sums: DataFrame, activities: DataFrame) -> DataFrame:
    """Mean score and workers per activity; an activity without workers is kept."""
    by_div = sums.withColumn("div", F.col("nic2").try_cast("int")).withColumn(
        "national_beta", ratio(grand_total("wx"), grand_total("w"))
    )
    return (
        activities.join(by_div, "div", "left")
        .groupBy("label", "value")
        .agg(
            ratio(F.sum("wx"), F.sum("w")).alias("mean_beta"),
            F.max("national_beta").alias("national_beta"),
            (F.coalesce(F.sum("w"), F.lit(0.0)) / MILLION).alias("workers_m"),
        )
    )


def value_weighted(bridge: DataFrame, value_total: int = V.ACTIVITY_TOTAL) -> DataFrame:
    """Value-weighted mean score and share of value in activities whose mean is
    above the national mean."""
    share = F.col("value") / value_total
    return bridge.agg(
        F.sum(share * F.col("mean_beta")).alias("value_weighted_beta"),
        sum_where(F.col("mean_beta") > F.col("national_beta"), share).alias("exposed_value_share"),
    )


def weight_sensitivity(merged: DataFrame, weights: Sequence[float] = (0.0, 0.5, 1.0)) -> DataFrame:
    """Headline statistics under several tooling weights, in one scan."""
    sums, entries = [F.sum("weight").alias("w"), F.sum(wage_bill()).alias("wb")], []
    for i, weight in enumerate(weights):
        s = reweighted(F.col("alpha"), F.col("zeta"), weight)
        sums += [
            F.sum(s * F.col("weight")).alias(f"sw{i}"),
            F.sum(s * wage_bill()).alias(f"sb{i}"),
            sum_where(is_high(s), "weight").alias(f"hw{i}"),
            sum_where(is_high(s), wage_bill()).alias(f"hb{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(float(weight)).alias("e2_weight"),
                ratio(F.col(f"sw{i}"), F.col("w")).alias("mean_emp_weighted"),
                ratio(F.col(f"sb{i}"), F.col("wb")).alias("mean_wagebill_weighted"),
                (ratio(F.col(f"hw{i}"), F.col("w")) * 100).alias("hi_worker_pct"),
                (ratio(F.col(f"hb{i}"), F.col("wb")) * 100).alias("hi_earnings_pct"),
            )
        )
    return scored(merged).agg(*sums).select(F.inline(F.array(*entries)))


def top_overlap(
    index: DataFrame, low: float = 0.0, high: float = 1.0, n: int = 10, min_tasks: int = 5
) -> DataFrame:
    """Groups among the top n at one weight, the other, or both."""
    kept = index.filter(F.col("n_tasks") >= min_tasks)

    def top(weight: float) -> DataFrame:
        score = reweighted(F.col("alpha"), F.col("zeta"), weight)
        return kept.select("group3", score.alias("_s")).orderBy(F.desc("_s"), "group3").limit(n).select("group3")

    at_low, at_high = top(low), top(high)
    both = at_low.intersect(at_high).withColumn("kind", F.lit("both"))
    entrants = at_high.subtract(at_low).withColumn("kind", F.lit("high_only"))
    leavers = at_low.subtract(at_high).withColumn("kind", F.lit("low_only"))
    return both.unionByName(entrants).unionByName(leavers)


def median_earnings(merged: DataFrame) -> DataFrame:
    """Exact median earnings of earners by group."""
    earners = scored(merged).filter(F.col("monthly_earnings") > 0)
    return group_median(earners, ["group3"], "monthly_earnings", "med_earn")
