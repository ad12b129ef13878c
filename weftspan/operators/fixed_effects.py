"""Fixed-effects regressions on panels, with cluster-robust errors.

Effects are removed by conjugate gradients on tables of one row per level; what
reaches the driver is k x k, k the number of slopes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.functions.numeric import asinh, ratio
from weftspan.functions.student import quantile, two_sided_p
from weftspan.plans.sizing import SMALL_ROWS, bounded_map, small_side
from weftspan.plans.storage import materialise
from weftspan.sources import fixed_values as V

TIDY = (
    "term string, estimate double, std_error double, t_value double, p_value double, "
    "ci_low double, ci_high double, n_obs bigint, n_clusters bigint, df bigint"
)


def cohort_panel(panel: DataFrame, exposure: DataFrame) -> DataFrame:
    """Net flow by industry, month and cohort, with the exposure of the industry.

    Young and older bands only; the bands between them are left out.
    """
    band = F.col("age_band")
    cohort = F.when(band.isin(V.YOUNG_BANDS), F.lit("young")).when(
        band.isin(V.OLDER_BANDS), F.lit("older")
    )
    summed = (
        panel.filter(F.col("industry").isNotNull())
        .withColumn("cohort", cohort)
        .filter(F.col("cohort").isNotNull())
        .groupBy("industry", "data_month", "cohort")
        .agg(F.sum("value").alias("net"))
    )
    scores = exposure.select("industry", F.col("mean_beta").alias("exposure"))
    return summed.join(small_side(scores), "industry")


def quarter_of(month: str = "data_month"):
    number = F.substring(month, 6, 2).cast("int")
    return F.concat(
        F.substring(month, 1, 4), F.lit("Q"), (F.floor((number - 1) / 3) + 1).cast("string")
    )


def with_outcome(panel: DataFrame, post_start: str = V.POST_START) -> DataFrame:
    """asinh of net flow, post flag and quarter."""
    return panel.select(
        "*",
        (F.col("data_month") >= post_start).cast("int").alias("post"),
        asinh("net").alias("asinh_net"),
        quarter_of().alias("quarter"),
    )


def drop_window(panel: DataFrame, first: str, last: str) -> DataFrame:
    return panel.filter(~F.col("data_month").between(first, last))


def normalised_outcome(
    panel: DataFrame, keys: Sequence[str] = ("industry", "cohort"), post_start: str = V.POST_START
) -> DataFrame:
    """Net flow over the unit's mean absolute net flow before the post date."""
    before = panel.filter(F.col("data_month") < post_start)
    scale = before.groupBy(*keys).agg(F.avg(F.abs("net")).alias("_scale"))
    return (
        panel.join(small_side(scale), list(keys), "left")
        .withColumn("normalised_net", ratio(F.col("net"), F.col("_scale")))
        .drop("_scale")
    )


@dataclass(frozen=True)
class Effects:
    """Level counts of the effects, and which of them lie within clusters."""

    levels: dict[str, int]
    nested: frozenset[str]

    def absorbed(self) -> int:
        """Parameters taken up by effects; an effect within the clusters
        counts as one."""
        total = sum(self.levels.values()) - (len(self.levels) - 1)
        return total - sum(self.levels[e] - 1 for e in self.nested)


def _dot(x: str, y: str, columns: Sequence[str], per: bool = False) -> list[Column]:
    product = {c: F.col(f"{x}_{c}") * F.col(f"{y}_{c}") for c in columns}
    return [F.sum(v / F.col("n") if per else v).alias(f"{x}{y}_{c}") for c, v in product.items()]


class Absorber:
    """Takes effects out of columns of a sample, all columns in each pass.

    The normal equations of the effects are solved by conjugate gradients with the level
    counts as preconditioner. What is iterated are tables with one row per level
    (of all effects, and of all samples where ``by`` tells several): coefficients,
    residuals and directions. A step reads the sample once, adds up the direction's
    levels along each row, and sums that by level; two numbers per column reach the
    driver. Rows are never rewritten. On balanced panels a few steps end it, and on
    unbalanced ones their number grows with the root of what alternating means need.
    """

    def __init__(self, sample: DataFrame, columns: Sequence[str], effects: Sequence[str], by: str, cluster: str):
        self.columns, self.effects, self.by = list(columns), list(effects), by
        spread = sample.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.sum(F.col(c) * F.col(c)).alias(f"s_{c}") for c in columns], F.count(F.lit(1)).alias("n")
        ).first()
        self.mean = {c: spread[f"m_{c}"] or 0.0 for c in columns}
        self.scale = {c: max((spread[f"s_{c}"] or 0.0) - spread["n"] * self.mean[c] ** 2, 1e-300) for c in columns}
        self.sample = sample.select(
            *[x for x in sample.columns if x not in columns], *[(F.col(c) - F.lit(self.mean[c])).alias(c) for c in columns]
        )
        begun = self._by_level(self.sample.withColumn("_k", F.col(cluster)), F.min("_k").alias("low"), F.max("_k").alias("high"))
        self.levels = materialise(begun, "levels")
        facts = self.levels.groupBy("by", "effect").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("low") == F.col("high")).alias("within")).collect()
        self.small = sum(f["n"] for f in facts) <= SMALL_ROWS
        self.facts = {}
        for f in facts:
            known = self.facts.setdefault(f["by"], ({}, set()))
            known[0][self.effects[f["effect"]]] = f["n"]
            if f["within"]:
                known[1].add(self.effects[f["effect"]])

    def absorbed(self, by: str) -> int:
        levels, nested = self.facts[by]
        return Effects(levels, frozenset(nested)).absorbed()

    def _by_level(self, rows: DataFrame, *more: Column) -> DataFrame:
        """Counts and sums of the columns by level of each effect."""
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("effect"), F.col(e).cast("string").alias("level")) for i, e in enumerate(self.effects)]))
        kept = [c for c in ("_k",) if c in rows.columns]
        long = rows.select(F.col(self.by).alias("by"), *kept, *self.columns, each.alias("_l")).select("by", "_l.effect", "_l.level", *kept, *self.columns)
        return long.groupBy("by", "effect", "level").agg(F.count(F.lit(1)).alias("n"), *more, *[F.sum(c).alias(f"q_{c}") for c in self.columns])

    def _met(self, table: DataFrame, name: str) -> tuple[DataFrame, dict[str, Column]]:
        """The sample beside its levels' values ``name``, and their sums by column."""
        rows, total = self.sample, dict.fromkeys(self.columns, F.lit(0.0))
        for i, e in enumerate(self.effects):
            part = table.filter(F.col("effect") == i).select(
                F.col("by").alias(self.by), F.col("level").alias(f"_level{i}"), *[F.col(f"{name}_{c}").alias(f"_{i}_{c}") for c in self.columns]
            )
            rows = rows.withColumn(f"_level{i}", F.col(e).cast("string")).join(F.broadcast(part) if self.small else part, [self.by, f"_level{i}"])
            total = {c: total[c] + F.col(f"_{i}_{c}") for c in self.columns}
        return rows, total

    def within(self, tolerance: float = 1e-11, most: int = 300) -> DataFrame:
        """The sample with the effects taken out of its columns."""
        table = self.levels.select(
            "by", "effect", "level", "n", *[F.lit(0.0).alias(f"a_{c}") for c in self.columns], *[F.col(f"q_{c}").alias(f"r_{c}") for c in self.columns],
            *[(F.col(f"q_{c}") / F.col("n")).alias(f"p_{c}") for c in self.columns],
        )
        for _ in range(most):
            rows, total = self._met(table, "p")
            sums = self._by_level(rows.select(*[x for x in self.sample.columns if x not in self.columns], *[total[c].alias(c) for c in self.columns])).drop("n")
            step = materialise(table.join(F.broadcast(sums) if self.small else sums, ["by", "effect", "level"]), "step")
            dots = step.agg(
                *_dot("r", "r", self.columns, True), *_dot("p", "q", self.columns), *_dot("r", "q", self.columns, True), *_dot("q", "q", self.columns, True)
            ).first()
            alpha, beta, rest = {}, {}, 0.0
            for c in self.columns:
                rr, pq = dots[f"rr_{c}"], dots[f"pq_{c}"]
                alpha[c] = rr / pq if pq and rr > 1e-32 * self.scale[c] else 0.0
                left = max(rr - 2 * alpha[c] * dots[f"rq_{c}"] + alpha[c] ** 2 * dots[f"qq_{c}"], 0.0) if alpha[c] else 0.0
                beta[c] = left / rr if rr else 0.0
                rest = max(rest, left / self.scale[c])
            residual = {c: F.col(f"r_{c}") - F.lit(alpha[c]) * F.col(f"q_{c}") for c in self.columns}
            table = step.select(
                "by", "effect", "level", "n",
                *[(F.col(f"a_{c}") + F.lit(alpha[c]) * F.col(f"p_{c}")).alias(f"a_{c}") for c in self.columns],
                *[residual[c].alias(f"r_{c}") for c in self.columns],
                *[(residual[c] / F.col("n") + F.lit(beta[c]) * F.col(f"p_{c}")).alias(f"p_{c}") for c in self.columns],
            )
            if rest <= tolerance**2:
                rows, total = self._met(table, "a")
                return rows.select(*[x for x in self.sample.columns if x not in self.columns], *[(F.col(c) - total[c]).alias(c) for c in self.columns])
        raise RuntimeError(f"effects did not settle in {most} steps")


def within_ols(
    df: DataFrame,
    y: str,
    terms: Sequence[str],
    effects: Sequence[str],
    cluster: str,
    by: str | None = None,
) -> DataFrame:
    """Least squares with absorbed effects; one row per term, and per sample if ``by``
    tells several samples: these share every pass.

    Errors are clustered (CRV1): G/(G-1) · (N-1)/(N-K) times the sandwich, K
    counting slopes and absorbed parameters; intervals use G - 1 degrees of
    freedom, G being the clusters of the estimation sample.
    """
    needed = list(dict.fromkeys([y, *terms, *effects, cluster, *([by] if by else [])]))
    numeric = [y, *terms]
    sample = df.select(
        *[F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in needed]
    ).dropna()
    group = by or "_sample"
    sample = materialise(sample.withColumn(group, F.col(by).cast("string") if by else F.lit("")), "panel")
    absorber = Absorber(sample, numeric, effects, group, cluster)
    within = materialise(absorber.within(), "within")

    k = len(terms)
    x = [F.col(t) for t in terms]
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(x[i] * F.col(y)).alias(f"b{i}") for i in range(k)]
    rows = {r[group]: r for r in within.groupBy(group).agg(*sums, F.count(F.lit(1)).alias("n")).collect()}
    inverses, slopes = {}, {}
    for name, row in rows.items():
        a = _symmetric(row, "a", k)
        inverses[name] = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
        slopes[name] = inverses[name] @ np.array([row[f"b{i}"] for i in range(k)])

    fitted = bounded_map(
        df.sparkSession, [(name, *map(float, s)) for name, s in slopes.items()], f"`{group}` string, " + ", ".join(f"_s{i} double" for i in range(k))
    )
    residual = F.col(y)
    for i in range(k):
        residual = residual - F.col(f"_s{i}") * x[i]
    scores = within.join(fitted, group).withColumn("_u", residual).groupBy(group, cluster).agg(
        *[F.sum(x[i] * F.col("_u")).alias(f"s{i}") for i in range(k)]
    )
    meats = scores.groupBy(group).agg(
        *[
            F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}")
            for i in range(k)
            for j in range(i, k)
        ],
        F.count(F.lit(1)).alias("g"),
    ).collect()
    out = []
    for meat in sorted(meats, key=lambda r: r[group]):
        name = meat[group]
        n, g = rows[name]["n"], meat["g"]
        parameters = k + absorber.absorbed(name)
        factor = (g / (g - 1.0)) * ((n - 1.0) / (n - parameters)) if g > 1 and n > parameters else math.nan
        variance = factor * inverses[name] @ _symmetric(meat, "m", k) @ inverses[name]
        errors = np.sqrt(np.diag(variance))
        out += [(*t, name) for t in tidy_rows(terms, slopes[name], errors, n, g)]
    found = df.sparkSession.createDataFrame(out, f"{TIDY}, `{group}` string")
    return found if by else found.drop(group)


def _symmetric(row, name: str, k: int) -> np.ndarray:
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"{name}{i}_{j}"]
    return a


def tidy_rows(terms, estimates, errors, n: int, g: int) -> list[tuple]:
    """Rows of a coefficient table: t and p values and 95 % intervals with G - 1 df."""
    df = g - 1
    reach = quantile(0.975, df) if df > 0 else math.nan
    rows = []
    for term, estimate, error in zip(terms, estimates, errors):
        t = float(estimate / error) if error else math.nan
        p = two_sided_p(t, df) if df > 0 and not math.isnan(t) else math.nan
        rows.append(
            (
                term, float(estimate), float(error), t, p,
                float(estimate - reach * error), float(estimate + reach * error),
                int(n), int(g), int(df),
            )
        )
    return rows


def did(panel: DataFrame, y: str = "asinh_net", by: str | None = None) -> DataFrame:
    """Exposure x post within the young cohort; industry and month effects."""
    young = panel.filter(F.col("cohort") == "young").withColumn(
        "exposure_post", F.col("exposure") * F.col("post")
    )
    return within_ols(young, y, ["exposure_post"], ["industry", "data_month"], "industry", by)


def triple_difference(panel: DataFrame, y: str = "asinh_net", by: str | None = None) -> DataFrame:
    """Exposure x post x young with industry-month, industry-cohort and
    month-cohort effects."""
    keyed = panel.select(
        "*",
        (F.col("exposure") * F.col("post") * (F.col("cohort") == "young").cast("int")).alias(
            "exposure_post_young"
        ),
        F.concat_ws("_", "industry", "data_month").alias("industry_month"),
        F.concat_ws("_", "industry", "cohort").alias("industry_cohort"),
        F.concat_ws("_", "data_month", "cohort").alias("month_cohort"),
    )
    return within_ols(
        keyed, y, ["exposure_post_young"],
        ["industry_month", "industry_cohort", "month_cohort"], "industry", by,
    )


def event_study(
    panel: DataFrame, y: str = "asinh_net", reference: str = V.REFERENCE_QUARTER
) -> DataFrame:
    """Exposure x quarter in the young cohort against a reference quarter."""
    young = panel.filter(F.col("cohort") == "young")
    quarters = sorted(r[0] for r in young.select("quarter").distinct().collect())
    terms = {q: f"exposure_{q}" for q in quarters if q != reference}
    wide = young.select(
        "*",
        *[
            (F.col("exposure") * (F.col("quarter") == q).cast("int")).alias(t)
            for q, t in terms.items()
        ],
    )
    fit = within_ols(wide, y, list(terms.values()), ["industry", "data_month"], "industry")
    return fit.withColumn("quarter", F.replace("term", F.lit("exposure_"), F.lit("")))


def robustness_menu(panel: DataFrame, window=V.REBOUND_WINDOW, other_post: str = "2023-03") -> DataFrame:
    """The two designs under a scale-free outcome, without a window, and with
    another post date; one row per specification and design. All samples of a
    design are fitted together."""
    panel = materialise(panel, "menu")
    base = normalised_outcome(panel)
    later = panel.withColumn("post", (F.col("data_month") >= other_post).cast("int"))
    menu = [
        ("asinh, full window", base, "asinh_net"),
        ("normalised, full window", base, "normalised_net"),
        ("asinh, window dropped", drop_window(base, *window), "asinh_net"),
        ("normalised, window dropped", drop_window(base, *window), "normalised_net"),
        ("normalised, later post", normalised_outcome(later, post_start=other_post), "normalised_net"),
    ]
    stacked = None
    for name, frame, y in menu:
        rows = frame.select("industry", "data_month", "cohort", "exposure", "post", F.col(y).alias("outcome"), F.lit(name).alias("spec"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    stacked = materialise(stacked, "specs")
    return did(stacked, "outcome", "spec").unionByName(triple_difference(stacked, "outcome", "spec"))
