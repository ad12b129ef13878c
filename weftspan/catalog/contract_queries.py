"""Contracts, gates and golden comparison (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.surrogates import PAYROLL_SQL, payroll_v, with_sql
from weftspan.operators import contracts as G
from weftspan.operators.panel import with_series_break
from weftspan.sources.io import table

ORDERS = G.Contract(
    "orders",
    (
        G.Field("o_orderkey", "bigint", unique=True),
        G.Field("o_custkey", "bigint", unique=True),
        G.Field("o_orderstatus", "string", isin=["O", "F"]),
        G.Field("o_totalprice", "double", gt=1000, le=400000),
        G.Field("o_orderpriority", "string", regex=r"^[1-3]-", min_length=6),
        G.Field("o_orderdate", "string"),
        G.Field("o_comment", "string"),
    ),
)


@query("contract_violations", "G1", """
    SELECT 'missing_column' AS rule, 'o_comment' AS "column", 1::BIGINT AS n
    UNION ALL SELECT 'type', 'o_orderdate', 1
    UNION ALL SELECT 'unique', 'o_custkey', sum(c)::BIGINT FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey HAVING count(*) > 1)
    UNION ALL SELECT 'isin', 'o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT * FROM (SELECT 'gt', 'o_totalprice', count(*) AS k FROM orders WHERE o_totalprice <= 1000) WHERE k > 0
    UNION ALL SELECT * FROM (SELECT 'le', 'o_totalprice', count(*) AS k FROM orders WHERE o_totalprice > 400000) WHERE k > 0
    UNION ALL SELECT 'regex', 'o_orderpriority', count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
    UNION ALL SELECT * FROM (SELECT 'min_length', 'o_orderpriority', count(*) AS k FROM orders WHERE length(o_orderpriority) < 6) WHERE k > 0""")
def contract_violations(spark, d):
    return G.violations(table(spark, d, "orders"), ORDERS).select("rule", "column", "n")


@query("panel_contract", "G1", with_sql(
    """SELECT 'isin' AS rule, 'age_band' AS "column", count(*) AS n FROM payroll_v WHERE age_band = '26-28'
       UNION ALL SELECT 'regex', 'data_month', count(*) FROM payroll_v WHERE substr(data_month, 6, 2) = '05'""", PAYROLL_SQL))
def panel_contract(spark, d):
    spoiled = (
        with_series_break(payroll_v(spark, d))
        .withColumn("source_release", F.lit("epfo_2025-05"))
        .withColumn("age_band", F.replace("age_band", F.lit("26-28"), F.lit("26-29")))
        .withColumn("data_month", F.regexp_replace("data_month", "-05$", "-5"))
    )
    return G.violations(spoiled, G.PAYROLL_PANEL).select("rule", "column", "n")


@query("numeric_gate", "G2", """
    SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS share,
           CASE WHEN avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) < 0.9 THEN 'FAIL' ELSE 'PASS' END AS gate FROM labels""")
def numeric_gate(spark, d):
    share = table(spark, d, "labels").agg(F.avg((F.col("quality") == 1).cast("double")).alias("share"))
    return G.gate(share, "share", minimum=0.9).withColumn("share", r("share"))


@query("golden_diff", "G3", """
    WITH new AS (SELECT c_custkey, c_mktsegment FROM customer),
         old AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'OLD' ELSE c_mktsegment END AS c_mktsegment FROM customer)
    SELECT *, 'new' AS side FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)
    UNION ALL SELECT *, 'golden' FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new)""")
def golden_diff(spark, d):
    new = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    old = new.withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, F.lit("OLD")).otherwise(F.col("c_mktsegment"))
    )
    return G.golden_diff(new, old)
