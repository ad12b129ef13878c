"""The payroll panel (P14 to P22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.surrogates import PAYROLL_SQL, payroll_v, with_sql
from weftspan.operators import panel as P

NATIONAL = "gender IS NULL AND industry IS NULL AND state IS NULL"


def psql(body: str) -> str:
    return with_sql(body, PAYROLL_SQL)


@query("payroll_panel", "P16", psql(
    "SELECT data_month, measure, age_band, gender, industry, state, value, data_month < '2020-04' AS series_break_flag FROM payroll_v"))
def payroll_panel(spark, d):
    return P.sorted_panel(P.with_series_break(payroll_v(spark, d)))


@query("duplicate_keys", "P14", psql(
    """SELECT data_month, measure, age_band, gender, industry, state, count(*) AS n
       FROM (SELECT * FROM payroll_v UNION ALL SELECT * FROM payroll_v WHERE value % 7 = 0) GROUP BY ALL HAVING count(*) > 1"""))
def duplicate_keys(spark, d):
    panel = payroll_v(spark, d)
    return P.duplicate_keys(panel.unionByName(panel.filter(F.col("value") % 7 == 0)))


@query("negative_gross", "P15", psql(
    "SELECT measure, count(*) AS n FROM payroll_v WHERE measure <> 'net_payroll' AND value - 2 < 0 GROUP BY measure"))
def negative_gross(spark, d):
    shifted = payroll_v(spark, d).withColumn("value", F.col("value") - 2)
    return P.negative_gross(shifted).groupBy("measure").agg(F.count(F.lit(1)).alias("n"))


@query("calendar_gaps", "P17", psql(
    f""", m AS (SELECT DISTINCT (substr(data_month, 1, 4)::INT * 2)::VARCHAR || substr(data_month, 5) AS data_month FROM payroll_v WHERE {NATIONAL})
       SELECT strftime(d, '%Y-%m') AS data_month FROM (
         SELECT unnest(generate_series((SELECT min(data_month || '-01')::DATE FROM m), (SELECT max(data_month || '-01')::DATE FROM m), INTERVAL 1 MONTH)) AS d)
       WHERE strftime(d, '%Y-%m') NOT IN (SELECT data_month FROM m)"""))
def calendar_gaps(spark, d):
    """Every year counted double: the calendar has gaps of a year between."""
    year = (F.substring("data_month", 1, 4).cast("int") * 2).cast("string")
    return P.calendar_gaps(payroll_v(spark, d).withColumn("data_month", F.concat(year, F.substring("data_month", 5, 3))))


@query("last_year_summary", "P18", psql(
    f""", t AS (SELECT data_month, sum(value) AS net, coalesce(sum(value) FILTER (age_band IN ('18-21', '22-25')), 0) AS young
              FROM payroll_v WHERE {NATIONAL} AND measure = 'net_payroll' GROUP BY data_month ORDER BY data_month DESC LIMIT 12)
       SELECT round(avg(net), 6) AS net_mean, round(sum(young) / sum(net), 6) AS young_share, count(*) AS n_months FROM t"""))
def last_year_summary(spark, d):
    return P.last_year_summary(payroll_v(spark, d)).select(r("net_mean"), r("young_share"), "n_months")


@query("panel_sanity", "P18 A7", psql(
    f"""SELECT min(data_month) FILTER ({NATIONAL}) AS months_first, max(data_month) FILTER ({NATIONAL}) AS months_last,
              count(DISTINCT data_month) FILTER ({NATIONAL}) AS n_months,
              count(DISTINCT data_month) FILTER (gender IS NOT NULL) AS months_gender,
              count(DISTINCT data_month) FILTER (state IS NOT NULL) AS months_state,
              count(DISTINCT data_month) FILTER (industry IS NOT NULL) AS months_industry,
              count(DISTINCT state) AS n_states, count(DISTINCT industry) AS n_industries,
              count(*) FILTER ({NATIONAL} AND measure = 'net_payroll' AND value < 0 AND data_month IN ('2020-04', '2020-05')) AS negative_low_cells,
              count(*) FILTER ({NATIONAL} AND measure = 'net_payroll' AND value < 0 AND age_band = '>35') AS negative_over35 FROM payroll_v"""))
def panel_sanity(spark, d):
    return P.sanity_counts(payroll_v(spark, d))


@query("gender_vs_national", "P19", psql(
    f"""SELECT data_month, measure, age_band, sum(value) FILTER (gender IS NOT NULL)::BIGINT AS gender_sum,
              sum(value) FILTER (gender IS NULL)::BIGINT AS national_value,
              sum(value) FILTER (gender IS NOT NULL) = sum(value) FILTER (gender IS NULL) AS matches
       FROM payroll_v WHERE measure <> 'net_payroll' AND industry IS NULL AND state IS NULL GROUP BY ALL"""
    .replace("GROUP BY ALL", "GROUP BY data_month, measure, age_band")))
def gender_vs_national(spark, d):
    return P.gender_vs_national(payroll_v(spark, d))


@query("flow_identity", "P20", psql(
    f"""SELECT data_month, age_band, max(value) FILTER (measure = 'new_subscribers') AS new_subscribers,
              max(value) FILTER (measure = 'ceased') AS ceased, max(value) FILTER (measure = 'rejoined') AS rejoined,
              max(value) FILTER (measure = 'net_payroll') AS net_payroll, 0::BIGINT AS residual
       FROM payroll_v WHERE {NATIONAL} GROUP BY data_month, age_band"""))
def flow_identity(spark, d):
    return P.flow_identity(payroll_v(spark, d))


TREND_SQL = f"""
  SELECT data_month, age_band, value,
         CASE WHEN count(*) OVER w = 6 THEN avg(value) OVER w / 1e3 END AS mean_k,
         data_month >= '2024-01' AS provisional
  FROM payroll_v WHERE {NATIONAL} AND measure = 'net_payroll' AND data_month >= '2020-04'
  WINDOW w AS (PARTITION BY age_band ORDER BY data_month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""


def trend_v(spark, d):
    out = P.trailing_mean(payroll_v(spark, d), provisional_from="2024-01")
    return out.withColumn("mean_k", F.col("mean_m") * 1e3).drop("mean_m")


@query("trailing_mean", "P21", psql(
    f"SELECT data_month, age_band, value, round(mean_k, 6) AS mean_k, provisional FROM ({TREND_SQL})"))
def trailing_mean(spark, d):
    return trend_v(spark, d).withColumn("mean_k", r("mean_k"))


@query("latest_values", "P22", psql(
    f"""SELECT age_band, round(arg_max(mean_k, data_month), 6) AS latest, max(data_month) AS data_month
        FROM ({TREND_SQL}) WHERE mean_k IS NOT NULL GROUP BY age_band"""))
def latest_values(spark, d):
    return P.latest_values(trend_v(spark, d), value="mean_k").withColumn("latest", r("latest"))
