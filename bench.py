"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from weftspan.catalog import all_queries  # noqa: E402

HEADLINE = [
    "exposure_by_region",
    "occupation_index",
    "index_hierarchy",
    "derived_workers",
    "unmatched_groups",
    "entry_rung",
    "score_histogram",
    "education_cut",
    "state_ranking",
    "section_wage_bill",
    "weight_sensitivity",
    "head_profile",
    "variance_share",
    "median_earnings",
    "task_statements",
    "code_segments",
    "sample_labels",
    "voted_labels",
    "upserted_responses",
    "bridged_scores",
    "divergence_stats",
    "rater_agreement",
    "fleiss_kappa",
    "stratified_sample",
    "seeded_shuffle",
    "two_stage_squares",
    "parsed_flow_blocks",
    "payroll_panel",
    "trailing_mean",
    "difference_in_differences",
    "group_features",
    "contract_violations",
    "robustness_menu",
    "chosen_typology",
    "kmeans_vectors",
    "parsed_entries",
    "triple_difference",
    "event_study",
    "silhouette_by_group",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["group_index"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
