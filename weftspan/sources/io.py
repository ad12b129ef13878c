"""Readers and sinks between stages."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftspan.sources.fixed_values import SURVEY_COLUMNS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_survey_csv(
    spark: SparkSession, path: str, schema: str, columns: Mapping[str, str] = SURVEY_COLUMNS
) -> DataFrame:
    """Survey microdata under a declared schema: no inference pass, and only
    the picked columns are parsed."""
    raw = spark.read.schema(schema).csv(path, header=True)
    return raw.select(*[F.col(c).alias(name) for c, name in columns.items()])


def read_text_csv(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """CSV with every column read as text.

    ``skip`` leading lines (titles above the header) are dropped by their
    place at the head of each file, and the header line after them; a line
    further down stays even if it is equal to one of these. With ``skip``, each file
    has a header of its own: columns go by name, and one that a file lacks is null.
    A field may not hold a line end then.
    """
    if not skip:
        return spark.read.csv(path, header=True, inferSchema=False)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # Ids rise by one within a file's first split; one row per file is kept of it.
    first = F.col("_block") == 0
    begins = lines.filter(first).groupBy("_file").agg(F.min("_at").alias("_begin"))
    placed = lines.join(begins, "_file").withColumn("_line", F.when(first, F.col("_at") - F.col("_begin")))
    headers = placed.filter(F.col("_line") == skip).select("_file", F.col("value").alias("_header"))
    kinds = [next(csv.reader([r["_header"]])) for r in headers.select("_header").distinct().collect()]
    names = list(dict.fromkeys(n.strip() for kind in kinds for n in kind))
    fields = ", ".join(f"_c{i} string" for i in range(max(map(len, kinds), default=0)))
    if not fields:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names) or "value string")

    def cells(line: Column) -> Column:
        row = F.from_csv(line, fields)
        return F.array(*[row[f.split()[0]] for f in fields.split(", ")])

    body = placed.filter(F.col("_line").isNull() | (F.col("_line") > skip)).join(headers, "_file")
    told = body.select(cells(F.col("value")).alias("_v"), F.transform(cells(F.col("_header")), lambda n: F.trim(n)).alias("_n"))
    return told.select(*[F.get("_v", F.array_position("_n", n).cast("int") - 1).alias(n) for n in names])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """CSV with a header. ``single_file`` is for result tables of a report."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").csv(path, header=True)
    return path


def write_json_report(report: DataFrame, path: str) -> str:
    """One JSON object per row of a report frame, beside the output it tells of."""
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(path)
    return path


def run_report(df: DataFrame, measures: Sequence[Column]) -> DataFrame:
    """One row of counts, shares and other aggregates of an output."""
    return df.agg(*measures)


def write_observed(df: DataFrame, path: str, measures: Sequence[Column]) -> dict:
    """Write an output as Parquet and return its run report, taken by the pass that
    writes. Measures are named aggregates without DISTINCT."""
    seen = Observation()
    df.observe(seen, *measures).write.mode("overwrite").parquet(path)
    return seen.get


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write a stage as a table of sorted buckets, for joins and groupings by ``key``
    that then move nothing of it. ``path`` is a folder all executors share."""
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a reader finds the path."""
    try:
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException:
        return False
    return True


def headcount_source(spark: SparkSession, workers_path: str, aggregate_path: str, fresh) -> DataFrame:
    """Group x division headcounts from worker rows, else the stored aggregate.

    ``fresh`` turns worker rows into the aggregate; both ways give the columns
    group3, nic_div, workers_m.
    """
    if exists(spark, workers_path):
        return fresh(spark.read.parquet(workers_path))
    if exists(spark, aggregate_path):
        schema = "group3 string, nic_div int, workers_m double"
        return spark.read.schema(schema).csv(aggregate_path, header=True)
    raise FileNotFoundError(f"need {workers_path} or {aggregate_path}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file of a folder, to hold against a manifest."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
