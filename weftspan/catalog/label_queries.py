"""Label resolution (C) over stored responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.surrogates import (
    MODEL, RESPONSES_SQL, RUBRIC, STATEMENTS_SQL, responses_v, statements_v, with_sql,
)
from weftspan.functions.labels import parse_response
from weftspan.operators import labels as C
from weftspan.operators.contracts import gate
from weftspan.plans.storage import scratch_path
from weftspan.sources import fixed_values as V

SAMPLES_SQL = RESPONSES_SQL + """,
samples_v AS (
  SELECT f.task_id, f.sample_idx, coalesce(f.label, t.label) AS label, f.label IS NULL AS retried,
         coalesce(t.response, f.response) AS last_response
  FROM (SELECT * FROM parsed_v WHERE sample_idx < 100) f
  LEFT JOIN (SELECT * FROM parsed_v WHERE sample_idx >= 100) t
    ON f.task_id = t.task_id AND t.sample_idx = f.sample_idx + 100),
votes_v AS (
  SELECT task_id, count(*) FILTER (label = 'E0') AS votes_e0, count(*) FILTER (label = 'E1') AS votes_e1,
         count(*) FILTER (label = 'E2') AS votes_e2 FROM samples_v GROUP BY task_id),
voted_v AS (
  SELECT *, CASE WHEN top = 0 THEN NULL
                 WHEN (votes_e0 = top)::INT + (votes_e1 = top)::INT + (votes_e2 = top)::INT > 1 THEN 'TIE'
                 WHEN votes_e0 = top THEN 'E0' WHEN votes_e1 = top THEN 'E1' ELSE 'E2' END AS score
  FROM (SELECT *, greatest(votes_e0, votes_e1, votes_e2) AS top FROM votes_v))"""

# Statements of the labelling run: one per three events, so that response
# keys exist for some samples only.
RUN_SQL = STATEMENTS_SQL + """,
run_v AS (
  SELECT task_id, nco_code, group3,
         sha256('7:model-a' || chr(1) || '3:0.2' || chr(1) || length(task_id::VARCHAR) || ':' || task_id || chr(1) || '1:0') AS key
  FROM statements_v)"""


def run_v(spark, d):
    return statements_v(spark, d).select(
        "task_id", "nco_code", "group3",
        C.content_key(F.lit(MODEL), F.lit(RUBRIC), "task_id", F.lit(0)).alias("key"),
    )


@query("response_keys", "C1", with_sql("SELECT task_id, sample_idx, key FROM responses_v", RESPONSES_SQL))
def response_keys(spark, d):
    return responses_v(spark, d).select("task_id", "sample_idx", "key")


@query(
    "label_work_list", "C2 F4",
    with_sql(
        "SELECT task_id, nco_code FROM run_v WHERE key NOT IN (SELECT key FROM responses_v)",
        RESPONSES_SQL, RUN_SQL,
    ),
)
def label_work_list(spark, d):
    return C.work_list(run_v(spark, d), responses_v(spark, d)).select("task_id", "nco_code")


@query(
    "label_first_wave", "C2",
    with_sql(
        """SELECT task_id FROM run_v WHERE key NOT IN (SELECT key FROM responses_v)
           ORDER BY task_id LIMIT 100""",
        RESPONSES_SQL, RUN_SQL,
    ),
)
def label_first_wave(spark, d):
    return C.work_list(run_v(spark, d), responses_v(spark, d), wave=100).select("task_id")


@query(
    "label_work_counts", "C2",
    with_sql(
        """SELECT count(*) FILTER (key IN (SELECT key FROM responses_v)) AS n_cached,
                  count(*) FILTER (key NOT IN (SELECT key FROM responses_v)) AS n_todo FROM run_v""",
        RESPONSES_SQL, RUN_SQL,
    ),
)
def label_work_counts(spark, d):
    return C.work_counts(run_v(spark, d), responses_v(spark, d))


@query(
    "projected_cost", "C3 G2",
    with_sql(
        """SELECT n_todo, round(n_todo * 3.45 / 1000, 6) AS worst_cost,
                  round(n_todo * 3.45 / 1000 + 10, 6) AS cumulative_worst,
                  CASE WHEN n_todo * 3.45 / 1000 + 10 > 200 THEN 'FAIL' ELSE 'PASS' END AS verdict
           FROM (SELECT count(*) AS n_todo FROM run_v WHERE key NOT IN (SELECT key FROM responses_v))""",
        RESPONSES_SQL, RUN_SQL,
    ),
)
def projected_cost(spark, d):
    todo = C.work_list(run_v(spark, d), responses_v(spark, d))
    cost = C.projected_cost(todo, 1650, 130, 1.5, 7.5, prior=10.0)
    return gate(cost, "cumulative_worst", maximum=V.BUDGET, name="verdict").select(
        "n_todo", r("worst_cost"), r("cumulative_worst"), "verdict"
    )


@query(
    "realised_cost", "C3",
    with_sql(
        """SELECT sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
                  round((sum(input_tokens) * 1.5 + sum(output_tokens) * 7.5) / 1e6, 6) AS cost FROM responses_v""",
        RESPONSES_SQL,
    ),
)
def realised_cost(spark, d):
    out = C.realised_cost(responses_v(spark, d), {"input_tokens": 1.5, "output_tokens": 7.5})
    return out.withColumn("cost", r("cost"))


@query(
    "parsed_responses", "C4",
    with_sql("SELECT task_id, sample_idx, label FROM parsed_v", RESPONSES_SQL),
)
def parsed_responses(spark, d):
    return responses_v(spark, d).select(
        "task_id", "sample_idx", parse_response("response").alias("label")
    )


@query(
    "sample_labels", "C5",
    with_sql("SELECT task_id, sample_idx, label, retried FROM samples_v", SAMPLES_SQL),
)
def sample_labels(spark, d):
    return C.sample_labels(responses_v(spark, d)).select("task_id", "sample_idx", "label", "retried")


@query(
    "voted_labels", "C6",
    with_sql(
        """SELECT task_id, votes_e0, votes_e1, votes_e2, score, coalesce(score = 'TIE', false) AS tie_escalated
           FROM voted_v""",
        SAMPLES_SQL,
    ),
)
def voted_labels(spark, d):
    return C.vote(C.sample_labels(responses_v(spark, d)))


@query(
    "assembled_labels", "C7 F1",
    with_sql(
        """SELECT s.task_id, s.nco_code, s.group3, p.label AS score, '0.2' AS rubric_version,
                  'model-a' AS model, 1::BIGINT AS n_samples, true AS preliminary
           FROM run_v s JOIN parsed_v p ON s.key = p.key WHERE p.label IS NOT NULL""",
        RESPONSES_SQL, RUN_SQL,
    ),
)
def assembled_labels(spark, d):
    return C.assemble(run_v(spark, d), responses_v(spark, d), RUBRIC, MODEL)


@query(
    "label_failure_rate", "C8 G2",
    with_sql(
        """SELECT count(*) AS n_tasks, count(*) FILTER (score IS NULL) AS n_failures,
                  round(count(*) FILTER (score IS NULL) / count(*), 6) AS failure_rate,
                  CASE WHEN count(*) FILTER (score IS NULL) / count(*) > 0.02 THEN 'FAIL' ELSE 'PASS' END AS verdict
           FROM voted_v""",
        SAMPLES_SQL,
    ),
)
def label_failure_rate(spark, d):
    rate = C.failure_rate(C.vote(C.sample_labels(responses_v(spark, d))))
    return gate(rate, "failure_rate", maximum=V.MAX_FAILURE_RATE, name="verdict").withColumn(
        "failure_rate", r("failure_rate")
    )


@query(
    "label_rejects", "C8 A8",
    with_sql(
        """SELECT task_id, 'unparseable sample ' || sample_idx::VARCHAR || ' after strict retry: '
                  || last_response AS reason FROM samples_v WHERE label IS NULL""",
        SAMPLES_SQL,
    ),
)
def label_rejects(spark, d):
    return C.rejects(C.sample_labels(responses_v(spark, d)))


@query(
    "label_distribution", "C9",
    with_sql("SELECT score, count(*) AS n FROM voted_v GROUP BY score", SAMPLES_SQL),
)
def label_distribution(spark, d):
    return C.label_distribution(C.vote(C.sample_labels(responses_v(spark, d))))


UPSERT_SQL = with_sql(
    """SELECT key, created_at, response FROM (
             SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, fresh DESC, response DESC) AS n
             FROM (SELECT key, created_at, response, 0 AS fresh FROM responses_v
                   UNION ALL
                   SELECT key, '2024-01-01T12', 'SCORE: E0', 1 FROM responses_v WHERE task_id % 2 = 0))
           WHERE n = 1""",
    RESPONSES_SQL,
)


@query("upserted_responses", "C10 F15", UPSERT_SQL)
def upserted_responses(spark, d):
    stored = responses_v(spark, d).select("key", "created_at", "response")
    new = responses_v(spark, d).filter(F.col("task_id") % 2 == 0).select(
        "key", F.lit("2024-01-01T12").alias("created_at"), F.lit("SCORE: E0").alias("response")
    )
    return C.latest_responses(stored, new)


@query("stored_upsert", "C10", UPSERT_SQL)
def stored_upsert(spark, d):
    """The same upsert into a stored table, of which only touched ranges are rewritten."""
    columns = ["key", "created_at", "response"]
    path = scratch_path(spark, "responses")
    C.upsert_store(spark, path, responses_v(spark, d).select(*columns))
    new = responses_v(spark, d).filter(F.col("task_id") % 2 == 0).select(
        "key", F.lit("2024-01-01T12").alias("created_at"), F.lit("SCORE: E0").alias("response")
    )
    return C.upsert_store(spark, path, new)
