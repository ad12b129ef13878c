"""Index queries (D) over event labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.surrogates import (
    IDX_SQL, LABELS_SQL, MEASURES_SQL, STATEMENTS_SQL, idx_v, labels_v, statements_v, with_sql,
)
from weftspan.operators import index as D

ROUNDED = "round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(zeta, 6) AS zeta"


def _rounded(df, *keys):
    return df.select(*keys, "n_tasks", r("alpha"), r("beta"), r("zeta"))


@query(
    "titled_labels", "D1 F1",
    with_sql(
        """SELECT l.task_id, l.nco_code, l.score, s.occupation_title
           FROM labels_v l JOIN statements_v s USING (task_id) WHERE l.score IN ('E0', 'E1', 'E2')""",
        LABELS_SQL, STATEMENTS_SQL,
    ),
)
def titled_labels(spark, d):
    return D.with_titles(labels_v(spark, d), statements_v(spark, d)).select(
        "task_id", "nco_code", "score", "occupation_title"
    )


@query(
    "occupation_index", "D1 D2 D3",
    with_sql(
        f"""SELECT l.nco_code, s.occupation_title, {MEASURES_SQL.replace("avg(", "round(avg(").replace(" END) AS", " END), 6) AS")},
                  'E1' AS variant, '0.2' AS rubric_version, true AS preliminary
           FROM labels_v l JOIN statements_v s USING (task_id)
           WHERE score IS NOT NULL GROUP BY l.nco_code, s.occupation_title""",
        LABELS_SQL, STATEMENTS_SQL,
    ),
)
def occupation_index(spark, d):
    scored = D.with_titles(labels_v(spark, d), statements_v(spark, d))
    out = D.build_index(
        scored, ["nco_code", "occupation_title"], rubric_version="0.2", preliminary=True
    )
    return _rounded(out, "nco_code", "occupation_title", "variant", "rubric_version", "preliminary")


@query(
    "group_index", "D2 D3",
    with_sql(f"SELECT group3, n_tasks, {ROUNDED} FROM idx_v", LABELS_SQL, IDX_SQL),
)
def group_index(spark, d):
    return _rounded(idx_v(spark, d), "group3")


LEVELS = ["group3", "family", "nco_code"]
HIERARCHY_SQL = """nodes_v AS (
  SELECT (3 - grouping(group3) - grouping(family) - grouping(nco_code))::INTEGER AS level,
         group3, family, nco_code, count(*) AS n_tasks,
         count(*) FILTER (score = 'E0') AS n_e0, count(*) FILTER (score = 'E1') AS n_e1,
         count(*) FILTER (score = 'E2') AS n_e2
  FROM labels_v WHERE score IS NOT NULL GROUP BY ROLLUP (group3, family, nco_code))"""


@query(
    "index_hierarchy", "D3 D7",
    with_sql(
        """SELECT level, group3, family, nco_code, n_tasks, n_e0, n_e1, n_e2,
                  round(n_e1 / n_tasks, 6) AS alpha, round((n_e1 + 0.5 * n_e2) / n_tasks, 6) AS beta,
                  round((n_e1 + n_e2) / n_tasks, 6) AS zeta FROM nodes_v""",
        LABELS_SQL, HIERARCHY_SQL,
    ),
)
def index_hierarchy(spark, d):
    return D.index_hierarchy(labels_v(spark, d), LEVELS).select(
        "level", *LEVELS, "n_tasks", "n_e0", "n_e1", "n_e2", r("alpha"), r("beta"), r("zeta")
    )


@query(
    "nested_hierarchy", "D7",
    with_sql(
        """SELECT g.group3, g.n_tasks, count(DISTINCT f.family) AS n_families,
                  count(o.nco_code) AS n_occupations, sum(o.n_tasks)::BIGINT AS tasks_below
           FROM nodes_v g JOIN nodes_v f ON f.level = 2 AND f.group3 = g.group3
           JOIN nodes_v o ON o.level = 3 AND o.family = f.family AND o.group3 = g.group3
           WHERE g.level = 1 GROUP BY ALL""",
        LABELS_SQL, HIERARCHY_SQL,
    ),
)
def nested_hierarchy(spark, d):
    nested = D.nest_hierarchy(D.index_hierarchy(labels_v(spark, d), LEVELS), LEVELS)
    occupations = F.flatten(F.transform("families", lambda f: f.getField("occupations")))
    return nested.select(
        "group3",
        "n_tasks",
        F.size("families").cast("bigint").alias("n_families"),
        F.size(occupations).cast("bigint").alias("n_occupations"),
        F.aggregate(
            occupations, F.lit(0).cast("bigint"), lambda acc, o: acc + o.getField("n_tasks")
        ).alias("tasks_below"),
    )


@query(
    "hierarchy_leaves", "D7",
    with_sql(
        """SELECT l.group3, l.family, l.nco_code, s.occupation_title, l.task_id, l.score
           FROM labels_v l JOIN statements_v s USING (task_id) WHERE l.score IN ('E0', 'E1', 'E2')""",
        LABELS_SQL, STATEMENTS_SQL,
    ),
)
def hierarchy_leaves(spark, d):
    titles = statements_v(spark, d).select("task_id", "occupation_title")
    return D.hierarchy_leaves(labels_v(spark, d).join(titles, "task_id"))


@query(
    "index_coverage", "D4",
    with_sql(
        """SELECT (SELECT count(*) FROM labels_v WHERE score IS NOT NULL) AS n_tasks_scored,
                  (SELECT count(*) FROM statements_v) AS n_tasks_total,
                  (SELECT count(*) FROM idx_v) AS n_groups3,
                  (SELECT count(*) FROM idx_v WHERE n_tasks < 5) AS groups_with_lt5_tasks,
                  round((SELECT count(*) FROM labels_v WHERE score IS NOT NULL) /
                        (SELECT count(*) FROM statements_v), 6) AS task_coverage""",
        LABELS_SQL, STATEMENTS_SQL, IDX_SQL,
    ),
)
def index_coverage(spark, d):
    out = D.coverage(labels_v(spark, d), statements_v(spark, d), idx_v(spark, d))
    return out.withColumn("task_coverage", r("task_coverage"))


@query(
    "reweighted_index", "D5",
    with_sql(
        """SELECT group3, w AS e2_weight, round(alpha + w * (zeta - alpha), 6) AS score_w
           FROM idx_v CROSS JOIN (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) t(w)""",
        LABELS_SQL, IDX_SQL,
    ),
)
def reweighted_index(spark, d):
    return D.reweighted_long(idx_v(spark, d)).select("group3", "e2_weight", r("score_w"))


@query(
    "label_waterfall", "D6",
    with_sql(
        """SELECT step::INTEGER AS step, segment, delta::BIGINT AS delta,
                  sum(delta) OVER (ORDER BY step)::BIGINT AS level
           FROM (SELECT 1 AS step, 'parsed' AS segment, count(*) AS delta FROM labels_v
                 UNION ALL SELECT 2, 'unresolved', -count(*) FROM labels_v WHERE score IS NULL
                 UNION ALL SELECT 3, 'scored', 0
                 UNION ALL SELECT 4, 'E0', -count(*) FROM labels_v WHERE score = 'E0'
                 UNION ALL SELECT 5, 'E1', -count(*) FROM labels_v WHERE score = 'E1'
                 UNION ALL SELECT 6, 'E2', -count(*) FROM labels_v WHERE score = 'E2')""",
        LABELS_SQL,
    ),
)
def label_waterfall(spark, d):
    return D.waterfall(labels_v(spark, d))


@query(
    "occupation_beta", "D8",
    with_sql(
        """SELECT nco_code, count(*) AS n_labels,
                  round(avg(CASE score WHEN 'E0' THEN 0.0 WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.5 END), 6) AS beta
           FROM labels_v GROUP BY nco_code""",
        LABELS_SQL,
    ),
)
def occupation_beta(spark, d):
    return D.beta_of_labels(labels_v(spark, d), ["nco_code"]).select(
        "nco_code", "n_labels", r("beta")
    )
