"""Share-based indices over task labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspan.functions.labels import LABELS, is_label, label_weight


def index_measures(score: str = "score") -> list[Column]:
    """n_tasks, alpha (chat alone), beta (tooling at half weight), zeta (either)."""
    s = F.col(score)
    return [
        F.count(F.lit(1)).alias("n_tasks"),
        F.avg((s == "E1").cast("double")).alias("alpha"),
        F.avg(label_weight(s)).alias("beta"),
        F.avg(s.isin("E1", "E2").cast("double")).alias("zeta"),
    ]


def with_titles(scores: DataFrame, statements: DataFrame) -> DataFrame:
    """Valid labels only, with the occupation title of their statement."""
    return scores.filter(is_label("score")).join(
        statements.select("task_id", "occupation_title"), "task_id"
    )


def build_index(
    scored: DataFrame,
    keys: Sequence[str],
    variant: str = "E1",
    rubric_version: str | None = None,
    preliminary: bool | None = None,
) -> DataFrame:
    """Index at a key list; provenance columns are added when given."""
    out = scored.filter(is_label("score")).groupBy(*keys).agg(*index_measures())
    if rubric_version is not None:
        out = out.withColumn("rubric_version", F.lit(rubric_version))
    if preliminary is not None:
        out = out.withColumn("variant", F.lit(variant)).withColumn(
            "preliminary", F.lit(preliminary)
        )
    return out


def index_hierarchy(scored: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Index at the total and at every prefix of ``levels`` in one shuffle.

    Labels are counted at the finest grain before the rollup, so the rollup
    multiplies group rows and not label rows. ``level`` is 0 for the total.
    """
    s = F.col("score")
    fine = (
        scored.filter(is_label("score"))
        .groupBy(*levels)
        .agg(*[F.count_if(s == x).alias(f"n_{x.lower()}") for x in LABELS])
    )
    depth = F.lit(len(levels)) - F.bit_count(F.grouping_id())
    rolled = fine.rollup(*levels).agg(
        depth.cast("int").alias("level"),
        *[F.sum(f"n_{x.lower()}").alias(f"n_{x.lower()}") for x in LABELS],
    )
    n = F.col("n_e0") + F.col("n_e1") + F.col("n_e2")
    return rolled.select(
        "level",
        *levels,
        n.alias("n_tasks"),
        "n_e0",
        "n_e1",
        "n_e2",
        (F.col("n_e1") / n).alias("alpha"),
        ((F.col("n_e1") + 0.5 * F.col("n_e2")) / n).alias("beta"),
        ((F.col("n_e1") + F.col("n_e2")) / n).alias("zeta"),
    )


def nest_hierarchy(
    nodes: DataFrame,
    levels: Sequence[str] = ("group3", "family", "nco_code"),
) -> DataFrame:
    """One row per top level with its lower levels as nested, sorted arrays.

    Only index nodes are nested, whose number is that of the classification; the
    tasks below them are rows of ``hierarchy_leaves``, at every size.
    """
    stats = ["n_tasks", "n_e0", "n_e1", "n_e2", "alpha", "beta", "zeta"]
    current = nodes.filter(F.col("level") == len(levels)).select(*levels, *stats)
    stats_here = list(stats)
    for depth in range(len(levels) - 1, 0, -1):
        name, parents = levels[depth], list(levels[:depth])
        entry = F.struct(F.col(name).alias("code"), *stats_here)
        children = {2: "occupations", 1: "families"}.get(depth, f"level_{depth}")
        folded = current.groupBy(*parents).agg(
            F.sort_array(F.collect_list(entry)).alias(children)
        )
        parent_stats = nodes.filter(F.col("level") == depth).select(*parents, *stats)
        current = parent_stats.join(folded, parents)
        stats_here = [*stats, children]
    return current


def hierarchy_leaves(titled: DataFrame, levels: Sequence[str] = ("group3", "family", "nco_code")) -> DataFrame:
    """Tasks of the hierarchy as rows: label, occupation title, and the keys of all
    levels above them."""
    return titled.filter(is_label("score")).select(*levels, "occupation_title", "task_id", "score")


def coverage(scores: DataFrame, statements: DataFrame, group_index: DataFrame) -> DataFrame:
    """Scored share of statements and number of groups with under five tasks."""
    scored = scores.agg(F.count_if(is_label("score")).alias("n_tasks_scored"))
    total = statements.agg(F.count(F.lit(1)).alias("n_tasks_total"))
    groups = group_index.agg(
        F.count(F.lit(1)).alias("n_groups3"),
        F.count_if(F.col("n_tasks") < 5).alias("groups_with_lt5_tasks"),
    )
    one = F.lit(1)
    parts = [p.withColumn("_one", one) for p in (scored, total, groups)]
    joined = parts[0].join(parts[1], "_one").join(parts[2], "_one").drop("_one")
    return joined.withColumn(
        "task_coverage", F.col("n_tasks_scored") / F.col("n_tasks_total")
    )


def reweighted(alpha: Column, zeta: Column, weight: float) -> Column:
    """Index at another tooling weight: alpha + w (zeta - alpha)."""
    return alpha + weight * (zeta - alpha)


def reweighted_long(index: DataFrame, weights: Sequence[float] = (0.0, 0.5, 1.0)) -> DataFrame:
    """One row per index row and weight; the weights are listed in the row."""
    entries = [
        F.struct(
            F.lit(float(w)).alias("e2_weight"),
            reweighted(F.col("alpha"), F.col("zeta"), w).alias("score_w"),
        )
        for w in weights
    ]
    return index.select("*", F.inline(F.array(*entries)))


def waterfall(scores: DataFrame, score: str = "score") -> DataFrame:
    """Steps from all statements to the labels, with the level after each step."""
    tally = scores.agg(
        F.count(F.lit(1)).alias("parsed"),
        F.count_if(~is_label(score)).alias("unresolved"),
        *[F.count_if(F.col(score) == x).alias(x) for x in LABELS],
    )
    steps = [
        ("parsed", F.col("parsed")),
        ("unresolved", -F.col("unresolved")),
        ("scored", F.lit(0).cast("long")),
        *[(x, -F.col(x)) for x in LABELS],
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"), F.lit(name).alias("segment"), delta.alias("delta")
            )
            for i, (name, delta) in enumerate(steps)
        ]
    )
    running = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return tally.select(F.inline(rows)).withColumn("level", F.sum("delta").over(running))


def beta_of_labels(
    scores: DataFrame, keys: Sequence[str], score: str = "score", name: str = "beta"
) -> DataFrame:
    """Beta of each label list, ties and unknown labels left out; null if none."""
    return scores.groupBy(*keys).agg(
        F.avg(label_weight(score)).alias(name), F.count(F.lit(1)).alias("n_labels")
    )
