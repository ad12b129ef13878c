"""Sampling, ranking and apportionment."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspan.functions.labels import LABELS
from weftspan.functions.numeric import grand_total
from weftspan.plans.ranking import hash_sequence, ordered_sequence, top_per_group
from weftspan.plans.sizing import small_side
from weftspan.plans.storage import materialise
from weftspan.sources.fixed_values import SAMPLE_PER_LABEL, SEED

#: Parts into which one pass cuts a range of priorities.
THRESHOLDS = 32


def seeded_digest(key: str, seed: int = SEED, salt: str = "") -> Column:
    """Draw number of a row: depends on its id and the seed only."""
    return F.md5(F.concat_ws("|", F.lit(f"{seed}{salt}"), F.col(key).cast("string")))


def stratified_sample(
    pool: DataFrame,
    key: str = "task_id",
    label: str = "label",
    exclude: DataFrame | None = None,
    n: int = SAMPLE_PER_LABEL,
    seed: int = SEED,
) -> DataFrame:
    """n rows per label (all if fewer), and every row without a label.

    Rows are drawn by the lowest digests of their label, in parts first, so
    the size of a label does not matter.
    """
    left = pool if exclude is None else pool.join(exclude.select(key), key, "left_anti")
    digest = left.withColumn("_draw", seeded_digest(key, seed))
    drawn = top_per_group(
        digest.filter(F.col(label).isin(LABELS)),
        [label],
        [F.col("_draw"), F.col(key)],
        n,
        spread=[key],
    ).withColumn("stratum", F.col(label))
    unresolved = digest.filter(F.col(label).isNull()).withColumn("stratum", F.lit("unresolved"))
    return drawn.unionByName(unresolved).drop("_draw")


def seeded_shuffle(df: DataFrame, key: str, seed: int = SEED, name: str = "seq") -> DataFrame:
    """Number rows from 1 in a seeded random order."""
    return hash_sequence(df, seeded_digest(key, seed, "s"), name, [key])


def blind_sheet(df: DataFrame, columns: Sequence[str], raters: int = 3) -> DataFrame:
    """Sheet for raters: the listed columns and empty rating and note columns."""
    blanks = [
        F.lit("").alias(f"{kind}_{i}")
        for kind in ("rating", "notes")
        for i in range(1, raters + 1)
    ]
    return df.select(*columns, *blanks)


def sheet_key(df: DataFrame, key: str = "task_id", label: str = "label") -> DataFrame:
    return df.select("seq", key, F.col(label).alias("model_label"), "stratum")


def _apportion(
    items: DataFrame, keys: Sequence[str], item: str, weight: str, total: Column, name: str
) -> DataFrame:
    """Largest-remainder shares within keys.

    Floors are given to all; what is missing goes to the largest fractions
    (then weight, then item). The shortfall is below the number of items, and
    the ranking is of items, never of the rows they were counted from.
    """
    spec = Window.partitionBy(*keys)
    joined = items.withColumn("_s", F.sum(weight).over(spec))
    quota = F.when(
        (total > 0) & (F.col("_s") > 0), F.col(weight) / F.col("_s") * total
    ).otherwise(F.lit(0.0))
    floors = joined.withColumn("_q", quota).withColumn("_f", F.floor("_q"))
    short = F.when(
        (total > 0) & (F.col("_s") > 0), total - F.sum("_f").over(spec)
    ).otherwise(F.lit(0))
    order = spec.orderBy(F.desc(F.col("_q") - F.col("_f")), F.desc(weight), F.asc(item))
    return (
        floors.withColumn("_short", short)
        .withColumn("_r", F.row_number().over(order))
        .withColumn(
            name,
            (F.col("_f") + F.when(F.col("_r") <= F.col("_short"), 1).otherwise(0)).cast("long"),
        )
        .drop("_s", "_q", "_f", "_short", "_r")
    )


def largest_remainder(
    items: DataFrame,
    weight: str,
    total: int | Column,
    item: str,
    name: str = "n",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Integer shares of a total in proportion to weights (Hamilton). ``total``
    may be a column that is constant within the keys."""
    t = F.lit(total) if isinstance(total, int) else total
    return _apportion(items, keys, item, weight, t, name)


def two_stage_squares(
    members: DataFrame,
    sectors: Sequence[str],
    unit_m: float = 1.0,
    sector: str = "sector",
    group: str = "group3",
    weight: str = "workers_m",
    score: str = "beta",
) -> DataFrame:
    """Squares to sectors, then to the groups of each sector.

    The number of squares is the rounded total; ties between sectors go to the
    order of ``sectors``, ties between groups to the higher score, then code.
    Groups with no square stay in the result with n = 0.
    """
    position = F.array_position(F.array(*[F.lit(s) for s in sectors]), F.col(sector)).cast("int")
    by_sector = members.groupBy(sector).agg(F.sum(weight).alias("sector_m"))
    counted = by_sector.withColumn("_pos", position).withColumn(
        "_total", F.rint(grand_total("sector_m") / unit_m)
    )
    squares = largest_remainder(
        counted, "sector_m", F.col("_total"), "_pos", "sector_squares"
    ).drop("_pos", "_total")
    placed = members.filter(F.col(weight) > 0).withColumn(
        "_place",
        F.row_number().over(
            Window.partitionBy(sector).orderBy(F.desc(F.coalesce(F.col(score), F.lit(0.0))), group)
        ),
    )
    joined = placed.join(small_side(squares), sector)
    return largest_remainder(
        joined, weight, F.col("sector_squares"), "_place", "n", [sector]
    ).drop("_place")


def sector_scores(members: DataFrame, sector="sector", weight="workers_m", score="beta") -> DataFrame:
    """Worker-weighted mean score per sector, beside the apportionment."""
    known = members.filter(F.col(score).isNotNull() & (F.col(weight) > 0))
    return known.groupBy(sector).agg(
        F.sum(weight).alias("workers_m"),
        (F.sum(F.col(weight) * F.col(score)) / F.sum(weight)).alias("beta"),
    )


def allocate_slots(
    divisions: DataFrame, n: int, division: str = "division", share: str = "share", cap: str = "cap"
) -> DataFrame:
    """Slots per division: at least one, at most its cap, near its quota.

    The greedy fill (largest quota minus slots first) and the greedy trim
    (largest slots minus quota first) are rankings of the single steps each
    division could take: priorities fall by one with every step, so taking the best
    steps overall is the same as taking them one at a time. The priority of the last
    step taken is found by counting: a pass counts, for many thresholds at once, how
    many steps reach each, and the next looks between two of them. Steps are never
    made into rows; at the end each division has at most one step left in doubt.
    """
    caps = divisions.agg(F.sum(cap).alias("caps")).first()["caps"]
    total = min(n, int(caps or 0))
    q = F.col(share) * total
    begun = divisions.select(division, share, cap, q.alias("_q")).withColumn(
        "_start", F.least(F.col(cap), F.greatest(F.lit(1), F.floor("_q"))).cast("long")
    )
    begun = materialise(begun, "slots")
    missing = total - int(begun.agg(F.sum("_start").alias("s")).first()["s"] or 0)
    grows, start = missing > 0, F.col("_start")
    steps = (F.col(cap) - start) if grows else (start - 1)

    def priority(t: Column) -> Column:
        return F.col("_q") - (start + t) if grows else (start - t) - F.col("_q")

    def reaching(least: float) -> Column:
        """How many of a division's steps have a priority of ``least`` or more."""
        rough = F.greatest(F.lit(0), F.least(steps, F.floor(priority(F.lit(0)) - least) + 1))
        more = F.when((rough < steps) & (priority(rough) >= least), rough + 1)
        fewer = F.when((rough > 0) & (priority(rough - 1) < least), rough - 1)
        return F.coalesce(more, fewer, rough)

    ends = begun.filter(steps > 0).agg(
        F.sum(steps).alias("n"), F.max(priority(F.lit(0))).alias("high"), F.min(priority(steps - 1)).alias("low")
    ).first()
    wanted = min(abs(missing), int(ends["n"] or 0))
    if not wanted:
        return begun.select(division, share, cap, start.alias("slots"))
    low, high = ends["low"], math.nextafter(ends["high"], math.inf)
    while high - low > 0.5:
        cuts = [low + (high - low) * i / THRESHOLDS for i in range(1, THRESHOLDS)]
        counts = begun.agg(*[F.sum(reaching(c)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        low = max([low, *[c for c, k in zip(cuts, counts, strict=True) if k >= wanted]])
        high = min([high, *[c for c, k in zip(cuts, counts, strict=True) if k < wanted]])
    sure = begun.withColumn("_sure", reaching(high)).withColumn("_edge", reaching(low) - F.col("_sure"))
    left = wanted - int(sure.agg(F.sum("_sure").alias("s")).first()["s"])
    doubt = sure.filter("_edge > 0").select(division, priority(F.col("_sure")).alias("_priority"))
    taken = ordered_sequence(doubt, [F.desc("_priority"), F.asc(division)], "_r").filter(F.col("_r") <= left)
    found = sure.join(small_side(taken.select(division, F.lit(1).alias("_one"))), division, "left")
    sign = 1 if grows else -1
    return found.select(division, share, cap, (start + sign * (F.col("_sure") + F.coalesce("_one", F.lit(0)))).alias("slots"))


def top_by_slots(
    groups: DataFrame, slots: DataFrame, division: str = "division", order: str = "share", tie: str = "group3"
) -> DataFrame:
    """The largest groups of each division, as many as it has slots."""
    joined = groups.join(small_side(slots.select(division, "slots")), division)
    return top_per_group(
        joined, [division], [F.desc(order), F.asc(tie)], "slots", "place", spread=[tie]
    )


def representatives(
    entries: DataFrame, group="group3", family="family", code="nco_code", archetype=".0100"
) -> DataFrame:
    """One entry per group: in the family with most entries (ties to the lowest
    code), the archetype entry if there is one, else the lowest code.

    Families are reduced to one row each before groups are compared.
    """
    families = entries.groupBy(group, family).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.min(F.when(F.endswith(code, F.lit(archetype)), F.col(code))).alias("_arch"),
        F.min(code).alias("_low"),
    )
    picked = families.groupBy(group).agg(
        F.min_by(
            F.struct(family, F.coalesce("_arch", "_low").alias(code), "n_entries"),
            F.struct((-F.col("n_entries")).alias("_m"), F.col(family)),
        ).alias("_p")
    )
    return picked.select(group, f"_p.{family}", f"_p.{code}", "_p.n_entries")


def unit_rows(cells: DataFrame, count: str = "n") -> DataFrame:
    """One row per unit of a count."""
    return cells.filter(F.col(count) > 0).select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))).alias("unit")
    )
