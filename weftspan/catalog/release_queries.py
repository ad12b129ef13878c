"""Parsing release tables (P1 to P13): printed from flows, then read back. The
SQL side never parses: it states the flows directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query
from weftspan.catalog.release_surrogate import RELEASE_SQL, release_lines_v, release_rows_v
from weftspan.catalog.surrogates import with_sql
from weftspan.functions import payroll as P
from weftspan.operators import release_rows as R

PANEL = ", ".join(R.PANEL)


def panel_v(spark, d):
    return R.parse_release_rows(release_rows_v(spark, d))


@query("parsed_flow_blocks", "P4 P6 P1 P2 P3", with_sql(
    f"SELECT {PANEL} FROM parsed WHERE gender IS NULL AND industry IS NULL AND state IS NULL", RELEASE_SQL))
def parsed_flow_blocks(spark, d):
    return R.national(panel_v(spark, d).panel)


@query("parsed_gender_blocks", "P5 P7 P8", with_sql(
    f"SELECT {PANEL} FROM parsed WHERE gender IS NOT NULL", RELEASE_SQL))
def parsed_gender_blocks(spark, d):
    return panel_v(spark, d).panel.filter(F.col("gender").isNotNull())


@query("parsed_industry_rows", "P9 P5", with_sql(
    f"SELECT {PANEL} FROM parsed WHERE industry IS NOT NULL", RELEASE_SQL))
def parsed_industry_rows(spark, d):
    return panel_v(spark, d).panel.filter(F.col("industry").isNotNull())


@query("parsed_state_rows", "P9 P5", with_sql(
    f"SELECT {PANEL} FROM parsed WHERE state IS NOT NULL", RELEASE_SQL))
def parsed_state_rows(spark, d):
    return panel_v(spark, d).panel.filter(F.col("state").isNotNull())


@query("parse_issues", "A8 P7 P8", with_sql(
    """, k AS (SELECT data_month, age_band, substr(data_month, 6, 2) AS mm, count(*) OVER (PARTITION BY data_month) AS n_bands FROM bands)
       SELECT kind, count(*) AS n FROM (
         SELECT CASE WHEN mm = '06' AND age_band = '>35' AND n_bands = 6 THEN 'repaired'
                     WHEN mm = '06' AND age_band = '>35' THEN 'dropped'
                     WHEN mm = '12' AND age_band IN ('>35', '29-35') THEN 'dropped'
                     WHEN mm = '09' AND age_band = '22-25' THEN 'mismatch' END AS kind FROM k)
       WHERE kind IS NOT NULL GROUP BY kind""", RELEASE_SQL))
def parse_issues(spark, d):
    detail = F.col("detail")
    kind = (
        F.when(detail.startswith("garbled"), F.lit("repaired"))
        .when(detail.startswith("dropped"), F.lit("dropped"))
        .when(detail.startswith("row-sum"), F.lit("mismatch"))
        .otherwise(F.lit("other"))
    )
    return panel_v(spark, d).issues.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("parsed_text_lines", "P10", with_sql(
    """SELECT data_month, measure, age_band, gender, sum(value)::BIGINT AS value FROM (
         SELECT data_month, measure, age_band, gender, value FROM parsed WHERE gender IS NOT NULL
         UNION ALL SELECT data_month, measure, age_band, NULL, value FROM parsed WHERE gender IS NOT NULL)
       WHERE NOT (substr(data_month, 6, 2) = '06' AND age_band = '>35')
       GROUP BY data_month, measure, age_band, gender""", RELEASE_SQL))
def parsed_text_lines(spark, d):
    return R.parse_text_lines(release_lines_v(spark, d)).panel.select(
        "data_month", "measure", "age_band", "gender", "value"
    )


OWNED = [(f"epfo_{y + 1}-05", f"{y}-01", f"{y}-11") for y in range(2018, 2025)]


@query("months_outside_release", "P11", with_sql(
    "SELECT source_release, data_month, count(*) AS n FROM parsed WHERE substr(data_month, 6, 2) = '12' GROUP BY ALL",
    RELEASE_SQL))
def months_outside_release(spark, d):
    return R.outside_release(panel_v(spark, d).panel, R.release_map(spark, OWNED))


@query("grid_mismatches", "P12", with_sql(
    """SELECT source_release AS release, data_month, age_band, value + 1 AS value, value AS flow_value FROM parsed
       WHERE measure = 'net_payroll' AND gender IS NULL AND industry IS NULL AND state IS NULL
         AND substr(data_month, 6, 2) = '07' AND age_band = '26-28'""", RELEASE_SQL))
def grid_mismatches(spark, d):
    found = panel_v(spark, d)
    return R.grid_mismatches(found.grid, found.panel).select(
        "release", "data_month", "age_band", "value", "flow_value"
    )


@query("national_from_gender", "P13", with_sql(
    """SELECT data_month, measure, age_band, sum(value)::BIGINT AS value FROM parsed WHERE gender IS NOT NULL
       GROUP BY data_month, measure, age_band""", RELEASE_SQL))
def national_from_gender(spark, d):
    rows = release_rows_v(spark, d).filter((F.col("page") % 10 == 5) & (F.col("page") < 200))
    panel = R.parse_release_rows(rows, national_from_gender=True).panel
    return R.national(panel).select("data_month", "measure", "age_band", "value")


@query("parsed_cells", "P1 P2 P3", """
    SELECT l_orderkey, l_linenumber, l_partkey AS number, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN l_orderkey END AS nil,
           CASE l_linenumber WHEN 1 THEN '<18' WHEN 2 THEN '18-21' WHEN 3 THEN '29-35' WHEN 4 THEN '>35' END AS band,
           strftime(l_shipdate + INTERVAL 23 YEAR, '%Y-%m') AS full_month,
           CASE WHEN strftime(l_shipdate + INTERVAL 23 YEAR, '%Y-%m') BETWEEN '2017-09' AND '2026-12'
                THEN strftime(l_shipdate + INTERVAL 23 YEAR, '%Y-%m') END AS short_month FROM lineitem""")
def parsed_cells(spark, d):
    from weftspan.sources.io import table

    line = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    day = (F.col("l_shipdate") + F.expr("INTERVAL 23 YEARS")).cast("date")
    printed = line.select(
        "l_orderkey", "l_linenumber",
        F.format_number("l_partkey", 0).alias("number"),
        F.when(n % 3 == 0, F.lit("–")).when(n % 3 == 1, F.col("l_orderkey").cast("string")).otherwise(F.lit("n/a")).alias("nil"),
        F.coalesce(
            F.when(n == 1, F.lit("A - Less  than 18")), F.when(n == 2, F.lit("18 - 21")),
            F.when(n == 3, F.lit("E -29-35")), F.when(n == 4, F.lit("F - >35")), F.lit("36-40"),
        ).alias("band"),
        F.date_format(day, "MMMM, yyyy").alias("full_month"),
        F.date_format(day, "MMM-yy").alias("short_month"),
    )
    return printed.select(
        "l_orderkey", "l_linenumber",
        P.parse_value("number").alias("number"), P.parse_value("nil").alias("nil"),
        P.parse_band("band").alias("band"), P.full_month("full_month").alias("full_month"),
        P.short_month("short_month").alias("short_month"),
    )
