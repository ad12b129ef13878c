"""Panel regressions (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.surrogates import (
    PAYROLL_SQL, flows_v, payroll_v, with_sql,
)
from weftspan.operators import fixed_effects as Q
from weftspan.operators.panel import densify
from weftspan.sources import fixed_values as V

# Exposure of an industry: share of its flow records that are new, which
# follows from the tables and differs between industries.
EXPOSURE_SQL = "exposure_v AS (SELECT industry, avg(nw) AS e FROM flows_v GROUP BY industry)"


def exposure_v(spark, d):
    return flows_v(spark, d).groupBy("industry").agg(F.avg("new").alias("mean_beta"))


def asinh_sql(x: str) -> str:
    return f"sign({x}) * ln(abs({x}) + sqrt({x} * {x} + 1.0))"


COHORT_SQL = """cohort_v AS (
  SELECT p.industry, data_month, CASE WHEN age_band IN ('18-21', '22-25') THEN 'young' ELSE 'older' END AS cohort,
         sum(value)::BIGINT AS net, max(e) AS exposure
  FROM payroll_v p JOIN exposure_v x ON p.industry = x.industry
  WHERE age_band IN ('18-21', '22-25', '29-35', '>35') GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3")


def cohort_v(spark, d):
    return Q.cohort_panel(payroll_v(spark, d), exposure_v(spark, d))


def qsql(body: str, *more: str) -> str:
    return with_sql(body, PAYROLL_SQL, EXPOSURE_SQL, COHORT_SQL, *more)


@query("cohort_panel", "Q1", qsql(
    "SELECT industry, data_month, cohort, net, round(exposure, 6) AS exposure FROM cohort_v"))
def cohort_panel(spark, d):
    return cohort_v(spark, d).withColumn("exposure", r("exposure"))


QUARTER = "substr(data_month, 1, 4) || 'Q' || ((substr(data_month, 6, 2)::INTEGER - 1) // 3 + 1)::VARCHAR"


@query("panel_outcome", "Q2", qsql(
    f"""SELECT industry, data_month, cohort, (data_month >= '2022-11')::INTEGER AS post,
               round({asinh_sql('net')}, 6) AS asinh_net, {QUARTER} AS quarter FROM cohort_v"""))
def panel_outcome(spark, d):
    return Q.with_outcome(cohort_v(spark, d)).select(
        "industry", "data_month", "cohort", "post", r("asinh_net"), "quarter"
    )


@query("normalised_outcome", "Q8", qsql(
    """, s AS (SELECT industry, cohort, avg(abs(net)) AS sc FROM cohort_v WHERE data_month < '2022-11' GROUP BY ALL)
       SELECT c.industry, data_month, c.cohort, round(net / sc, 6) AS normalised_net
       FROM cohort_v c JOIN s ON c.industry = s.industry AND c.cohort = s.cohort
       WHERE NOT (data_month BETWEEN '2020-04' AND '2021-03')"""))
def normalised_outcome(spark, d):
    out = Q.drop_window(Q.normalised_outcome(cohort_v(spark, d)), *V.REBOUND_WINDOW)
    return out.select("industry", "data_month", "cohort", r("normalised_net"))


def balanced(spark, d):
    """Every industry, month and cohort, zero where nothing was printed."""
    cells = cohort_v(spark, d)
    keyed = cells.select(
        F.concat_ws("|", "industry", "cohort").alias("unit"), "data_month", "net"
    )
    units = cells.select(F.concat_ws("|", "industry", "cohort").alias("unit"))
    full = densify(keyed, "unit", "data_month", "net", units, cells).withColumn(
        "industry", F.substring_index("unit", "|", 1)
    ).withColumn("cohort", F.substring_index("unit", "|", -1))
    scores = exposure_v(spark, d).select("industry", F.col("mean_beta").alias("exposure"))
    return Q.with_outcome(full.drop("unit").join(scores, "industry"))


BALANCED_SQL = f"""grid AS (
  SELECT u.industry, u.cohort, m.data_month, coalesce(c.net, 0) AS net, x.e AS exposure,
         (m.data_month >= '2022-11')::INTEGER AS post
  FROM (SELECT DISTINCT industry, cohort FROM cohort_v) u CROSS JOIN (SELECT DISTINCT data_month FROM cohort_v) m
  LEFT JOIN cohort_v c ON c.industry = u.industry AND c.cohort = u.cohort AND c.data_month = m.data_month
  JOIN exposure_v x ON x.industry = u.industry),
bal AS (SELECT *, {asinh_sql('net')} AS y, {QUARTER} AS quarter FROM grid)"""

DID_SQL = """young AS (SELECT *, exposure * post AS x FROM bal WHERE cohort = 'young'),
dm AS (SELECT industry,
         y - avg(y) OVER (PARTITION BY industry) - avg(y) OVER (PARTITION BY data_month) + avg(y) OVER () AS yt,
         x - avg(x) OVER (PARTITION BY industry) - avg(x) OVER (PARTITION BY data_month) + avg(x) OVER () AS xt FROM young),
slope AS (SELECT sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n FROM dm),
score AS (SELECT industry, sum(xt * (yt - b * xt)) AS s FROM dm, slope GROUP BY industry),
facts AS (SELECT count(DISTINCT industry) AS g, count(DISTINCT data_month) AS m FROM young),
meat AS (SELECT sum(s * s) AS v FROM score)"""


@query("difference_in_differences", "Q3 Q6", qsql(
    """SELECT 'exposure_post' AS term, round(b, 6) AS estimate,
              round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - (1 + m)) * v) / sxx, 6) AS std_error,
              n AS n_obs, g AS n_clusters FROM slope, facts, meat""", BALANCED_SQL, DID_SQL))
def difference_in_differences(spark, d):
    return Q.did(balanced(spark, d)).select(
        "term", r("estimate"), r("std_error"), "n_obs", "n_clusters"
    )


@query("triple_difference", "Q4 Q6", qsql(
    """, k AS (SELECT *, exposure * post * (cohort = 'young')::INTEGER AS x FROM bal),
       dm AS (SELECT """ + ", ".join(
        f"""{v} - avg({v}) OVER (PARTITION BY industry, data_month) - avg({v}) OVER (PARTITION BY industry, cohort)
            - avg({v}) OVER (PARTITION BY data_month, cohort) + avg({v}) OVER (PARTITION BY industry)
            + avg({v}) OVER (PARTITION BY data_month) + avg({v}) OVER (PARTITION BY cohort) - avg({v}) OVER () AS {v}t"""
        for v in ("x", "y")) + """ FROM k)
       SELECT 'exposure_post_young' AS term, round(sum(xt * yt) / sum(xt * xt), 6) AS estimate, count(*) AS n_obs FROM dm""",
    BALANCED_SQL))
def triple_difference(spark, d):
    return Q.triple_difference(balanced(spark, d)).select("term", r("estimate"), "n_obs")


@query("event_study", "Q5", qsql(
    """, young AS (SELECT industry, exposure, quarter, avg(y) AS ym FROM bal WHERE cohort = 'young' GROUP BY ALL),
       ref AS (SELECT industry, exposure, ym FROM young WHERE quarter = '2022Q4')
       SELECT quarter, round(regr_slope(ym, exposure) - (SELECT regr_slope(ym, exposure) FROM ref), 6) AS estimate
       FROM young WHERE quarter <> '2022Q4' GROUP BY quarter""", BALANCED_SQL))
def event_study(spark, d):
    return Q.event_study(balanced(spark, d)).select("quarter", r("estimate"))


#: Rounds of alternating means in the SQL twin, far beyond what these panels need.
ROUNDS_SQL = 150


def inside_sql(t: str, df: str) -> str:
    """Probability that a Student's t with a whole number of degrees lies within -t and t."""
    sine, cosine = f"({t} / sqrt({df} + {t} * {t}))", f"sqrt({df} / ({df} + {t} * {t}))"
    even = f"list_sum(list_transform(range(0, {df} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow({cosine}, 2 * j)))"
    odd = f"list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow({cosine}, 2 * j + 1)))"
    return f"CASE WHEN {df} % 2 = 0 THEN {sine} * {even} ELSE 2 / pi() * (asin({sine}) + {sine} * coalesce({odd}, 0)) END"


def means_sql(values: str, key: str) -> str:
    return f"SELECT * REPLACE (y - avg(y) OVER (PARTITION BY spec, term, {key}) AS y, x - avg(x) OVER (PARTITION BY spec, term, {key}) AS x) FROM ({values})"


def spec_sql(name: str, outcome: str, post: str, dropped: bool = False) -> str:
    window = f"WHERE NOT (data_month BETWEEN '{V.REBOUND_WINDOW[0]}' AND '{V.REBOUND_WINDOW[1]}')" if dropped else ""
    return f"SELECT '{name}' AS spec, c.industry, data_month, c.cohort, exposure, (data_month >= '{post}')::INTEGER AS post, {outcome} AS y FROM cohort_v c JOIN scales_v s ON s.industry = c.industry AND s.cohort = c.cohort {window}"


FIT_SQL = f"""scales_v AS (SELECT industry, cohort, avg(abs(net)) FILTER (data_month < '2022-11') AS s1, avg(abs(net)) FILTER (data_month < '2023-03') AS s2
  FROM cohort_v GROUP BY industry, cohort),
specs_v AS ({" UNION ALL ".join([
    spec_sql("asinh, full window", asinh_sql("net"), "2022-11"), spec_sql("normalised, full window", "CASE WHEN s1 <> 0 THEN net / s1 END", "2022-11"),
    spec_sql("asinh, window dropped", asinh_sql("net"), "2022-11", True),
    spec_sql("normalised, window dropped", "CASE WHEN s1 <> 0 THEN net / s1 END", "2022-11", True),
    spec_sql("normalised, later post", "CASE WHEN s2 <> 0 THEN net / s2 END", "2023-03")])}),
rows_v AS (
  SELECT spec, 'exposure_post' AS term, industry AS c, industry AS e1, '' AS e2, data_month AS e3, y::DOUBLE AS y, (exposure * post)::DOUBLE AS x FROM specs_v WHERE cohort = 'young' AND y IS NOT NULL
  UNION ALL
  SELECT spec, 'exposure_post_young', industry, industry || '_' || data_month, industry || '_' || cohort, data_month || '_' || cohort, y::DOUBLE,
         (exposure * post * (cohort = 'young')::INTEGER)::DOUBLE FROM specs_v WHERE y IS NOT NULL),
rounds_v AS (
  SELECT 0 AS turn, * FROM rows_v
  UNION ALL
  SELECT turn + 1, * EXCLUDE (turn) FROM ({means_sql(means_sql(means_sql(f"SELECT * FROM rounds_v WHERE turn < {ROUNDS_SQL}", "e1"), "e2"), "e3")})),
within_v AS (SELECT * FROM rounds_v WHERE turn = {ROUNDS_SQL}),
slopes_v AS (SELECT spec, term, sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n, count(DISTINCT c) AS g, count(DISTINCT e3) AS m FROM within_v GROUP BY spec, term),
meat_v AS (SELECT spec, term, sum(s * s) AS v FROM (SELECT spec, term, c, sum(x * (y - b * x)) AS s FROM within_v JOIN slopes_v USING (spec, term) GROUP BY spec, term, c) GROUP BY spec, term),
fits_v AS (SELECT *, g - 1 AS df, sqrt(g / (g - 1.0) * (n - 1.0) / (n - (1 + m)) * v) / xx AS se FROM slopes_v JOIN meat_v USING (spec, term)),
halves_v AS (
  SELECT 0 AS turn, df, 0.0::DOUBLE AS low, 1000.0::DOUBLE AS high FROM (SELECT DISTINCT df FROM fits_v)
  UNION ALL
  SELECT turn + 1, df, CASE WHEN reach < 0.95 THEN mid ELSE low END, CASE WHEN reach < 0.95 THEN high ELSE mid END
  FROM (SELECT *, {inside_sql("mid", "df")} AS reach FROM (SELECT *, (low + high) / 2 AS mid FROM halves_v WHERE turn < 80))),
tidy_v AS (
  SELECT spec, term, round(b, 6) AS estimate, round(se, 6) AS std_error, round(b / se, 6) AS t_value, round(1 - ({inside_sql("abs(b / se)", "f.df")}), 6) AS p_value,
         round(b - low * se, 6) AS ci_low, round(b + low * se, 6) AS ci_high, n AS n_obs, g AS n_clusters, f.df AS df
  FROM fits_v f JOIN halves_v h ON h.df = f.df AND h.turn = 80)"""


def fit_sql(body: str) -> str:
    return qsql(body, FIT_SQL).replace("WITH ", "WITH RECURSIVE ", 1)


def tidy_columns():
    return ["term", *[r(c) for c in ("estimate", "std_error", "t_value", "p_value", "ci_low", "ci_high")], "n_obs", "n_clusters", "df"]


@query("coefficient_table", "Q3 Q7", fit_sql("SELECT * EXCLUDE (spec) FROM tidy_v WHERE spec = 'asinh, full window' AND term = 'exposure_post'"))
def coefficient_table(spark, d):
    return Q.did(Q.with_outcome(cohort_v(spark, d))).select(*tidy_columns())


@query("robustness_menu", "Q3 Q4 Q8", fit_sql("SELECT * FROM tidy_v"))
def robustness_menu(spark, d):
    return Q.robustness_menu(Q.with_outcome(cohort_v(spark, d))).select("spec", *tidy_columns())
