"""Joins between classifications, divergence and head statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspan.functions.numeric import grand_total, ratio, zero_fill
from weftspan.plans.ranking import top_per_group
from weftspan.plans.sizing import small_side
from weftspan.sources.maps import in_range


def overlay(base: DataFrame, newer: DataFrame, key: str, column: str) -> DataFrame:
    """Full join on a shared key; the newer value is preferred where present."""
    right = newer.select(key, F.col(column).alias("_new"))
    return base.select(key, column).join(right, key, "full").select(
        key, F.coalesce("_new", column).alias(column)
    )


def without_ids(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def with_ids(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return df.join(wanted.select(key), key, "left_semi")


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in both, only left, only right."""
    a, b = left.select(key), right.select(key)
    return (
        a.intersect(b).withColumn("kind", F.lit("both"))
        .unionByName(a.subtract(b).withColumn("kind", F.lit("left_only")))
        .unionByName(b.subtract(a).withColumn("kind", F.lit("right_only")))
    )


def bridge_scores(
    scores: DataFrame, bridge: DataFrame, units: DataFrame, values: Sequence[str]
) -> DataFrame:
    """External scores carried over three hops to unit groups.

    scores(code, values...) on the new taxonomy; bridge(code, old_code) with
    missing links falling back to the code itself; the first seven characters
    without hyphen are the join code to units(join_code, unit). Values are
    averaged per join code and then per three-digit group of the zero-filled
    unit; a code that meets two units of a group counts twice.
    """
    linked = scores.join(bridge, "code", "left").withColumn(
        "join_code",
        F.replace(
            F.substring(F.coalesce("old_code", "code"), 1, 7), F.lit("-"), F.lit("")
        ).try_cast("bigint"),
    )
    per_code = linked.groupBy("join_code").agg(*[F.avg(v).alias(v) for v in values])
    grouped = units.select(
        "join_code", F.substring(zero_fill("unit", 4), 1, 3).alias("group3")
    )
    return (
        grouped.join(per_code, "join_code")
        .groupBy("group3")
        .agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_pairs"))
    )


def chain_mean(
    scores: DataFrame, hops: Sequence[tuple[DataFrame, str, str]], value: str
) -> DataFrame:
    """Mean of a value after each hop of a chain of many-to-many maps.

    Each hop is (map, from, to); the value is averaged per target key before
    the next hop, so every join meets one row per key on the value side.
    """
    current, pairs = scores, None
    for mapping, source, target in hops:
        joined = mapping.select(source, target).join(current, source)
        current = joined.groupBy(target).agg(
            F.avg(value).alias(value), F.count(F.lit(1)).alias("n_pairs")
        )
    return current


def divergence(native: DataFrame, other: DataFrame, weights: DataFrame) -> DataFrame:
    """Native minus crosswalked score per group, with the group's weight."""
    return (
        native.select("group3", "beta_native")
        .join(small_side(other.select("group3", "beta_other")), "group3")
        .join(small_side(weights.select("group3", "workers_m")), "group3", "left")
        .withColumn("gap", F.col("beta_native") - F.col("beta_other"))
    )


def extremes(df: DataFrame, by: str, n: int = 8, tie: str = "group3") -> DataFrame:
    """The n lowest and n highest rows by a value."""
    low = top_per_group(df, [], [F.asc(by), F.asc(tie)], n, "place")
    high = top_per_group(df, [], [F.desc(by), F.desc(tie)], n, "place")
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))


def divergence_stats(diverged: DataFrame, big: float = 0.10) -> DataFrame:
    w = F.coalesce(F.col("workers_m"), F.lit(0.0))
    gap = F.abs(F.col("gap"))
    return diverged.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.corr("beta_native", "beta_other").alias("correlation"),
        F.avg("beta_native").alias("mean_native"),
        F.avg("beta_other").alias("mean_other"),
        ratio(F.sum(F.col("beta_native") * w), F.sum(w)).alias("wmean_native"),
        ratio(F.sum(F.col("beta_other") * w), F.sum(w)).alias("wmean_other"),
        F.avg(gap).alias("mean_abs_gap"),
        ratio(F.sum(gap * w), F.sum(w)).alias("wmean_abs_gap"),
        F.count_if(gap >= big).alias("n_big"),
        F.coalesce(F.sum(F.when(gap >= big, w)), F.lit(0.0)).alias("big_workers_m"),
    )


def text_mismatches(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """How many equal ids carry different text."""
    other = right.select(key, F.col(text).alias("_other"))
    return left.join(other, key).agg(
        F.count_if(F.trim(text) != F.trim("_other")).alias("n_mismatched")
    )


def aligned_join(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """Join by id, or by text if any shared id carries different text."""
    other = right.select(key, F.col(text))
    drifted = text_mismatches(left, right, key, text).first()["n_mismatched"] > 0
    if drifted:
        return left.drop(key).join(other, text)
    return left.join(other.select(key), key)


def head_profile(sums: DataFrame, heads: DataFrame) -> DataFrame:
    """Mean, spread and shares per head from sums per division.

    Heads may share divisions; a division counts in each of its heads.
    """
    mean = F.col("wx") / F.col("w")
    spread = F.greatest(F.col("wxx") / F.col("w") - mean * mean, F.lit(0.0))
    totals = heads.join(sums, "nic2").groupBy(F.col("head").alias("industry"), "position").agg(
        *[F.sum(c).alias(c) for c in ("w", "wx", "wxx", "w_hi", "w_wc")],
        F.array_join(F.sort_array(F.collect_list("nic2")), "+").alias("nic2"),
    )
    return totals.filter(F.col("w") != 0).select(
        "industry",
        "nic2",
        (F.col("w") / 1e6).alias("workers_m"),
        mean.alias("mean_beta"),
        F.sqrt(spread).alias("sd_within"),
        (F.col("w_hi") / F.col("w")).alias("share_hi"),
        (F.col("w_wc") / F.col("w")).alias("share_white_collar"),
    )


def head_volumes(panel: DataFrame) -> DataFrame:
    """Absolute and net payroll volume per industry head."""
    return panel.filter(F.col("industry").isNotNull()).groupBy("industry").agg(
        F.sum(F.abs("value")).alias("abs_volume"), F.sum("value").alias("net_total")
    )


def volume_weighted(heads: DataFrame, volumes: DataFrame) -> DataFrame:
    """Mean and standard deviation of head scores, weighted by absolute volume."""
    v = F.coalesce(F.col("abs_volume"), F.lit(0))
    joined = heads.join(small_side(volumes), "industry", "left").select(
        F.col("mean_beta").alias("x"), v.alias("v")
    )
    moments = joined.agg(
        F.sum("v").alias("v"),
        F.sum(F.col("x") * F.col("v")).alias("vx"),
        F.sum(F.col("x") * F.col("x") * F.col("v")).alias("vxx"),
    )
    mean = ratio(F.col("vx"), F.col("v"))
    return moments.select(
        mean.alias("weighted_mean"),
        F.sqrt(F.greatest(ratio(F.col("vxx"), F.col("v")) - mean * mean, F.lit(0.0))).alias(
            "weighted_sd"
        ),
    )


def first_head(heads: DataFrame) -> DataFrame:
    """Each division with the first head that lists it."""
    return heads.groupBy("nic2").agg(F.min_by("head", "position").alias("head"))


def variance_share(sums: DataFrame, heads: DataFrame) -> DataFrame:
    """Between-head share of score variance, and mapped share of all weight."""
    mapped = sums.withColumn("_all", grand_total("w")).join(first_head(heads), "nic2")
    per_head = mapped.groupBy("head").agg(
        *[F.sum(c).alias(c) for c in ("w", "wx", "wxx")], F.max("_all").alias("_all")
    )
    parts = per_head.agg(
        F.sum("w").alias("w"),
        F.sum("wx").alias("wx"),
        F.sum("wxx").alias("wxx"),
        F.max("_all").alias("_all"),
        F.sum(F.col("wx") * F.col("wx") / F.col("w")).alias("hb"),
    )
    grand = F.col("wx") * F.col("wx") / F.col("w")
    return parts.select(
        ratio(F.col("hb") - grand, F.col("wxx") - grand).alias("eta2"),
        (F.col("w") / F.col("_all")).alias("mapped_share"),
    )


def index_quartiles(heads: DataFrame, value: str = "mean_beta") -> DataFrame:
    """Range and the elements at ⌊n/4⌋ and ⌊3n/4⌋ of the sorted values (no
    interpolation). For head tables, whose length is that of the head map."""
    sorted_values = F.sort_array(F.collect_list(value))
    one = heads.agg(sorted_values.alias("v"))
    n = F.size("v")
    return one.select(
        n.cast("long").alias("n"),
        F.array_min("v").alias("low"),
        F.array_max("v").alias("high"),
        F.get("v", F.floor(n / 4).cast("int")).alias("q1"),
        F.get("v", F.floor(n * 3 / 4).cast("int")).alias("q3"),
    )


def sector_split(
    headcounts: DataFrame, indexed_groups: DataFrame, sectors
) -> tuple[DataFrame, DataFrame]:
    """Headcounts by (group, sector), and the millions left out because the
    group has no labels or the row has no sector."""
    flagged = (
        headcounts.join(
            small_side(indexed_groups.select("group3").distinct().withColumn("_has", F.lit(True))),
            "group3",
            "left",
        )
        .withColumn("indexed", F.coalesce("_has", F.lit(False)))
        .withColumn("sector", in_range(F.col("nic_div"), sectors))
    )
    kept = (
        flagged.filter(F.col("indexed") & F.col("sector").isNotNull())
        .groupBy("group3", "sector")
        .agg(F.sum("workers_m").alias("workers_m"))
    )

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("workers_m"))), F.lit(0.0))

    left_out = flagged.agg(
        total(~F.col("indexed")).alias("unindexed_m"),
        total(F.col("indexed") & F.col("sector").isNull()).alias("unsectored_m"),
    )
    return kept, left_out


def vintage_drift(
    original: DataFrame, modern: DataFrame, group_scores: DataFrame, key: str = "nco_code"
) -> DataFrame:
    """Drift of beta between two task lists, and how much of the gap to the
    group's crosswalked score it closes (if the gap is above 0.05)."""
    groups = group_scores.select("group3", F.round("beta_other", 2).alias("beta_group"))
    joined = (
        original.join(modern, key)
        .join(small_side(groups), "group3", "left")
        .select(
            key,
            "group3",
            F.round("beta_original", 3).alias("beta_original"),
            F.round("beta_modern", 3).alias("beta_modern"),
            F.round(F.col("beta_modern") - F.col("beta_original"), 3).alias("drift"),
            "beta_group",
        )
    )
    gap = F.col("beta_group") - F.col("beta_original")
    return joined.withColumn(
        "gap_closure_share",
        F.when(F.abs(gap) > 0.05, F.round(F.col("drift") / gap, 2)),
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.agg(
        F.avg("drift").alias("mean_drift"),
        F.avg("beta_original").alias("mean_original"),
        F.avg("beta_modern").alias("mean_modern"),
        F.avg("gap_closure_share").alias("mean_closure"),
    )


def layered_lookup(
    rows: DataFrame, layers: Sequence[DataFrame], key: str, value: str
) -> DataFrame:
    """First known value from several partial sources, in order; each source is
    made unique by key first (smallest value)."""
    out, names = rows, []
    for i, layer in enumerate(layers):
        name = f"_layer{i}"
        unique = layer.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(name))
        out = out.join(unique, key, "left")
        names.append(name)
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def ordered_pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key by a total order, with partial results before the shuffle."""
    return top_per_group(df, keys, order, 1)


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
