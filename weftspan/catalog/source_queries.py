"""Readers and sinks (A): driver tables written to shared scratch space in each
format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.surrogates import (
    IDX_SQL, LABELS_SQL, WORKERS_SQL, idx_v, labels_v, with_sql, workers_v,
)
from weftspan.operators import survey as S
from weftspan.plans.storage import scratch_path
from weftspan.sources import fixed_values as V
from weftspan.sources import io
from weftspan.sources.maps import head_map

RAW_SCHEMA = (
    "b1q3_perv1 int, state_perv1 int, b4q5_perv1 int, b4q6_perv1 int, b4q8_perv1 int, "
    "b5pt1q3_perv1 int, b5pt1q5_perv1 int, b5pt1q6_perv1 int, b5pt1q13_perv1 int, "
    "b6q9_perv1 double, b6q10_perv1 double, mult_perv1 bigint, no_qtr_perv1 int, NSS_perv1 int, NSC_perv1 int"
)


@query("survey_csv_scan", "A1 A4 E5", """
    SELECT lpad((o_orderkey % 130)::VARCHAR, 3, '0') AS group3, count(*) AS n,
           round(sum(CASE WHEN o_custkey % 2 = 0 THEN 5.0 ELSE 2.5 END) , 6) AS weight,
           round(sum(CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey END), 6) AS earnings
    FROM orders WHERE o_custkey % 6 * 10 + 11 IN (11, 21, 31, 41, 51) GROUP BY 1""")
def survey_csv_scan(spark, d):
    o = io.table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    values = [
        key % 2 + 1, cust % 36, key % 3 + 1, key % 90, key % 13 + 1, cust % 6 * 10 + 11,
        key % 99 * 1000, key % 130, key % 9 + 1,
        F.when(cust % 5 != 0, cust.cast("double")), F.lit(None).cast("double"),
        F.lit(1000), F.lit(2), cust % 2, F.lit(0),
    ]
    raw = o.select(*[v.alias(n) for v, n in zip(values, V.SURVEY_COLUMNS)])
    path = io.write_csv(raw, scratch_path(spark, "survey-csv"))
    workers = S.derive_workers(io.read_survey_csv(spark, path, RAW_SCHEMA))
    return workers.groupBy("group3").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.sum("weight"), "weight"),
        r(F.sum("monthly_earnings"), "earnings"),
    )


@query("parquet_round_trip", "A2", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def parquet_round_trip(spark, d):
    orders = io.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = io.write_parquet(orders, scratch_path(spark, "orders"), ["o_orderstatus"])
    return spark.read.parquet(path).filter(F.col("o_orderstatus") == "F")


@query("text_csv_table", "A3", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment, c_acctbal::VARCHAR AS c_acctbal FROM customer")
def text_csv_table(spark, d):
    customer = io.table(spark, d, "customer")
    path = io.write_csv(customer, scratch_path(spark, "customer"))
    return io.read_text_csv(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("titled_csv_tables", "A5", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def titled_csv_tables(spark, d):
    """Two files with titles above headers that differ in columns and their order."""
    customer = io.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_mktsegment")
    odd = F.col("c_custkey").cast("long") % 2
    body = customer.select(
        odd.alias("part"), F.lit(3).alias("at"),
        F.when(odd == 0, F.to_csv(F.struct("c_custkey", "c_name", "c_mktsegment"))).otherwise(F.to_csv(F.struct("c_name", "c_custkey"))).alias("value"),
    )
    heads = [(p, at, v) for p, h in ((0, "c_custkey,c_name,c_mktsegment"), (1, "c_name, c_custkey")) for at, v in enumerate(("Customers", "", h))]
    lines = body.unionByName(spark.createDataFrame(heads, "part long, at int, value string"))
    path = scratch_path(spark, "titled")
    lines.repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
    return io.read_text_csv(spark, path, skip=2).select("c_custkey", "c_name", "c_mktsegment")


@query("observed_report", "A7", """
    SELECT count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_filled, round(avg(o_totalprice), 4) AS mean_price,
           max(o_orderkey) AS last_key FROM orders WHERE o_totalprice > 1000""")
def observed_report(spark, d):
    """The run report of a written table, counted while it was written."""
    orders = io.table(spark, d, "orders").filter(F.col("o_totalprice") > 1000)
    report = io.write_observed(orders, scratch_path(spark, "observed"), [
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o_orderstatus") == "F").alias("n_filled"),
        F.avg("o_totalprice").alias("mean_price"), F.max("o_orderkey").alias("last_key"),
    ])
    row = spark.createDataFrame([report], "n_rows long, n_filled long, mean_price double, last_key long")
    return row.withColumn("mean_price", r("mean_price", digits=4))


@query("bucketed_join", "A2", """
    SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 4) AS price, max(o_totalprice) AS o_totalprice
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def bucketed_join(spark, d):
    """Two stages stored in buckets of one key; neither moves when they are joined and grouped by it."""
    stored = {}
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        path = scratch_path(spark, name)
        rows = io.table(spark, d, name).select(key, "o_totalprice" if name == "orders" else "l_extendedprice")
        stored[name] = io.write_bucketed(rows, f"weftspan_{path.rsplit('-', 1)[-1]}", path, key, 8)
    joined = stored["lineitem"].join(stored["orders"].hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("l_extendedprice"), "price", 4), F.max("o_totalprice").alias("o_totalprice")
    )


@query("csv_result_sink", "A4", with_sql("SELECT group3, n_tasks, round(beta, 6) AS beta FROM idx_v", LABELS_SQL, IDX_SQL))
def csv_result_sink(spark, d):
    result = idx_v(spark, d).select("group3", "n_tasks", r("beta"))
    path = io.write_csv(result, scratch_path(spark, "index"), single_file=True)
    return spark.read.schema("group3 string, n_tasks bigint, beta double").csv(path, header=True)


@query("head_map_workers", "A6 F5", with_sql(
    "SELECT head, pos AS position, count(*) AS n FROM workers_v JOIN heads ON nic2 = nic GROUP BY head, pos", WORKERS_SQL,
    "heads(head, pos, nic) AS (VALUES " + ", ".join(f"('{h}', {i}, '{n}')" for i, (h, ns) in enumerate(V.HEAD_DIVISIONS) for n in ns) + ")"))
def head_map_workers(spark, d):
    counts = workers_v(spark, d).groupBy(S.division_of().alias("nic2")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(head_map(spark, V.HEAD_DIVISIONS), "nic2").groupBy("head", "position").agg(
        F.sum("n").alias("n")
    )


@query("run_report", "A7", with_sql(
    """SELECT count(*) AS n_statements, count(score) AS n_labelled, round(count(score) / count(*), 6) AS coverage,
              count(DISTINCT nco_code) AS n_occupations, count(DISTINCT group3) AS n_groups FROM labels_v""", LABELS_SQL))
def run_report(spark, d):
    measures = [
        F.count(F.lit(1)).alias("n_statements"),
        F.count("score").alias("n_labelled"),
        r(F.count("score") / F.count(F.lit(1)), "coverage"),
        F.count_distinct("nco_code").alias("n_occupations"),
        F.count_distinct("group3").alias("n_groups"),
    ]
    report = io.run_report(labels_v(spark, d), measures)
    path = io.write_json_report(report, scratch_path(spark, "report"))
    return spark.read.schema(report.schema).json(path)


@query("stored_headcounts", "A9 E10", with_sql(
    """SELECT group3, TRY_CAST(nic2 AS INTEGER) AS nic_div, round(sum(weight) / 1e6, 7) AS workers_m
       FROM workers_v GROUP BY 1, 2""", WORKERS_SQL))
def stored_headcounts(spark, d):
    aggregate = scratch_path(spark, "headcounts")
    io.write_csv(S.headcount(workers_v(spark, d)).withColumn("workers_m", r("workers_m", digits=7)), aggregate)
    missing = scratch_path(spark, "no-workers")
    return io.headcount_source(spark, missing, aggregate, S.headcount)


@query("fresh_headcounts", "A9 E10", with_sql(
    """SELECT group3, TRY_CAST(nic2 AS INTEGER) AS nic_div, round(sum(weight) / 1e6, 7) AS workers_m
       FROM workers_v GROUP BY 1, 2""", WORKERS_SQL))
def fresh_headcounts(spark, d):
    workers = scratch_path(spark, "workers")
    io.write_parquet(workers_v(spark, d), workers)
    found = io.headcount_source(spark, workers, scratch_path(spark, "no-headcounts"), S.headcount)
    return found.withColumn("workers_m", r("workers_m", digits=7))
