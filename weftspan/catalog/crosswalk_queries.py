"""Joins and crosswalks (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.survey_queries import SECTION_SQL, first_range, ranges_sql
from weftspan.catalog.surrogates import (
    IDX_SQL, LABELS_SQL, MERGED_SQL, STATEMENTS_SQL, WORKERS_SQL, idx_v, labels_v, merged_v,
    statements_v, with_sql, workers_v,
)
from weftspan.functions.numeric import weighted_mean
from weftspan.operators import crosswalk as X
from weftspan.operators import survey as S
from weftspan.operators.index import beta_of_labels
from weftspan.sources import fixed_values as V
from weftspan.sources.io import table
from weftspan.sources.maps import range_map, recode


@query(
    "left_join_other_name", "F2",
    """SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_nationkey = r_regionkey""",
)
def left_join_other_name(spark, d):
    # Nation numbers beyond those of the regions find no match.
    region = table(spark, d, "region")
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey, "left")
        .join(region, F.col("n_nationkey") == F.col("r_regionkey"), "left")
        .select("c_custkey", "n_name", "r_name")
    )


@query(
    "preferred_side", "F3",
    """SELECT coalesce(e.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, e.quality) AS quality
       FROM (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS quality FROM documents) e
       FULL JOIN (SELECT doc_id, quality FROM labels) l ON e.doc_id = l.doc_id""",
)
def preferred_side(spark, d):
    guess = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("quality")
    )
    return X.overlay(guess, table(spark, d, "labels"), "doc_id", "quality")


@query(
    "documents_without_label", "F4",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def documents_without_label(spark, d):
    return X.without_ids(
        table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id"
    )


@query(
    "documents_with_label", "F5",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def documents_with_label(spark, d):
    return X.with_ids(
        table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id"
    )


@query(
    "group_key_sets", "F6 F19",
    with_sql(
        """SELECT coalesce(i.group3, w.group3) AS group3,
                  CASE WHEN w.group3 IS NULL THEN 'left_only' WHEN i.group3 IS NULL THEN 'right_only' ELSE 'both' END AS kind
           FROM idx_v i FULL JOIN (SELECT DISTINCT group3 FROM workers_v) w ON i.group3 = w.group3""",
        LABELS_SQL, IDX_SQL, WORKERS_SQL,
    ),
)
def group_key_sets(spark, d):
    return X.key_sets(idx_v(spark, d), workers_v(spark, d), "group3")


def external_scores(spark, d):
    """Scores per part on a made-up newer taxonomy: dashed codes with a suffix."""
    p = table(spark, d, "part")
    six = F.lpad((F.col("p_partkey") % 1000).cast("string"), 4, "0")
    return p.select(
        F.concat(F.lit("15-"), six, F.lit(".0"), (F.col("p_partkey") % 7).cast("string")).alias("code"),
        (F.col("p_size") / 50).alias("beta_a"),
        (F.col("p_retailprice") / 3000).alias("beta_b"),
    )


EXTERNAL_SQL = """ext AS (
  SELECT '15-' || lpad((p_partkey % 1000)::VARCHAR, 4, '0') || '.0' || (p_partkey % 7)::VARCHAR AS code,
         p_size / 50 AS beta_a, p_retailprice / 3000 AS beta_b FROM part),
bridge AS (
  SELECT DISTINCT '15-' || lpad((s_suppkey % 1000)::VARCHAR, 4, '0') || '.0' || (s_suppkey % 7)::VARCHAR AS code,
         '15-' || lpad((s_suppkey % 1000 // 2)::VARCHAR, 4, '0') || '.00' AS old_code FROM supplier),
units AS (
  SELECT DISTINCT (150000 + l_partkey % 1000)::BIGINT AS join_code, (l_suppkey % 90 * 11 + l_linenumber)::INTEGER AS unit FROM lineitem),
per_code AS (
  SELECT replace(substr(coalesce(b.old_code, e.code), 1, 7), '-', '')::BIGINT AS join_code,
         avg(beta_a) AS beta_a, avg(beta_b) AS beta_b
  FROM ext e LEFT JOIN bridge b ON e.code = b.code GROUP BY 1),
carried AS (
  SELECT substr(lpad(unit::VARCHAR, 4, '0'), 1, 3) AS group3, avg(beta_a) AS beta_a, avg(beta_b) AS beta_b,
         count(*) AS n_pairs
  FROM units JOIN per_code USING (join_code) GROUP BY 1)"""


@query(
    "bridged_scores", "F7",
    with_sql(
        "SELECT group3, round(beta_a, 6) AS beta_a, round(beta_b, 6) AS beta_b, n_pairs FROM carried",
        EXTERNAL_SQL,
    ),
)
def bridged_scores(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")

    def dashed(n, tail):
        return F.concat(F.lit("15-"), F.lpad(n.cast("string"), 4, "0"), F.lit("."), tail)

    bridge = s.select(
        dashed(key % 1000, F.concat(F.lit("0"), (key % 7).cast("string"))).alias("code"),
        dashed(F.floor(key % 1000 / 2).cast("bigint"), F.lit("00")).alias("old_code"),
    ).distinct()
    units = table(spark, d, "lineitem").select(
        (F.lit(150000) + F.col("l_partkey") % 1000).cast("bigint").alias("join_code"),
        (F.col("l_suppkey") % 90 * 11 + F.col("l_linenumber")).cast("int").alias("unit"),
    ).distinct()
    out = X.bridge_scores(external_scores(spark, d), bridge, units, ["beta_a", "beta_b"])
    return out.select("group3", r("beta_a"), r("beta_b"), "n_pairs")


@query(
    "chain_mean", "F7",
    """WITH one AS (SELECT p_brand, avg(p_retailprice) AS v FROM part GROUP BY p_brand),
            brand_type AS (SELECT DISTINCT p_brand, p_type FROM part),
            two AS (SELECT p_type, avg(v) AS v FROM brand_type JOIN one USING (p_brand) GROUP BY p_type),
            type_size AS (SELECT DISTINCT p_type, p_size FROM part)
       SELECT p_size, round(avg(v), 6) AS v, count(*) AS n_pairs FROM type_size JOIN two USING (p_type) GROUP BY p_size""",
)
def chain_mean(spark, d):
    p = table(spark, d, "part")
    start = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    hops = [
        (p.select("p_brand", "p_type").distinct(), "p_brand", "p_type"),
        (p.select("p_type", "p_size").distinct(), "p_type", "p_size"),
    ]
    return X.chain_mean(start, hops, "v").select("p_size", r("v"), "n_pairs")


DIVERGE_SQL = """other AS (
  SELECT p_brand AS group3, avg(p_size) / 50 AS beta_other FROM part GROUP BY p_brand),
weights AS (SELECT group3, sum(weight) / 1e6 AS workers_m FROM scored_v GROUP BY group3),
diverged AS (
  SELECT i.group3, i.beta AS beta_native, o.beta_other, w.workers_m, i.beta - o.beta_other AS gap
  FROM idx_v i JOIN other o ON i.group3 = o.group3 LEFT JOIN weights w ON i.group3 = w.group3)"""


def diverged_v(spark, d):
    native = idx_v(spark, d).select("group3", F.col("beta").alias("beta_native"))
    other = table(spark, d, "part").groupBy(F.col("p_brand").alias("group3")).agg(
        (F.avg("p_size") / 50).alias("beta_other")
    )
    weights = (
        merged_v(spark, d).filter(F.col("beta").isNotNull())
        .groupBy("group3").agg((F.sum("weight") / 1e6).alias("workers_m"))
    )
    return X.divergence(native, other, weights)


@query(
    "divergence_extremes", "F8 F15",
    with_sql(
        """SELECT * FROM (
             SELECT group3, round(beta_native, 6) AS beta_native, round(beta_other, 6) AS beta_other, round(gap, 6) AS gap,
                    'low' AS side, (row_number() OVER (ORDER BY gap, group3))::INTEGER AS place FROM diverged
             UNION ALL
             SELECT group3, round(beta_native, 6), round(beta_other, 6), round(gap, 6), 'high',
                    (row_number() OVER (ORDER BY gap DESC, group3 DESC))::INTEGER FROM diverged)
           WHERE place <= 8""",
        MERGED_SQL, DIVERGE_SQL,
    ),
)
def divergence_extremes(spark, d):
    return X.extremes(diverged_v(spark, d), "gap").select(
        "group3", r("beta_native"), r("beta_other"), r("gap"), "side", "place"
    )


@query(
    "divergence_stats", "F9",
    with_sql(
        """SELECT count(*) AS n_groups, round(corr(beta_native, beta_other), 6) AS correlation,
                  round(avg(beta_native), 6) AS mean_native, round(avg(beta_other), 6) AS mean_other,
                  round(sum(beta_native * coalesce(workers_m, 0)) / sum(coalesce(workers_m, 0)), 6) AS wmean_native,
                  round(sum(beta_other * coalesce(workers_m, 0)) / sum(coalesce(workers_m, 0)), 6) AS wmean_other,
                  round(avg(abs(gap)), 6) AS mean_abs_gap,
                  round(sum(abs(gap) * coalesce(workers_m, 0)) / sum(coalesce(workers_m, 0)), 6) AS wmean_abs_gap,
                  count(*) FILTER (abs(gap) >= 0.02) AS n_big,
                  round(coalesce(sum(workers_m) FILTER (abs(gap) >= 0.02), 0), 7) AS big_workers_m FROM diverged""",
        MERGED_SQL, DIVERGE_SQL,
    ),
)
def divergence_stats(spark, d):
    out = X.divergence_stats(diverged_v(spark, d), big=0.02)
    return out.select(
        "n_groups",
        *[r(c) for c in out.columns if c not in ("n_groups", "n_big", "big_workers_m")],
        "n_big",
        r("big_workers_m", digits=7),
    )


def drifted(spark, d):
    s = statements_v(spark, d).select("task_id", "task_text")
    return s.withColumn(
        "task_text",
        F.when(F.col("task_id") % 50 == 0, F.concat("task_text", F.lit(" x"))).otherwise(
            F.concat(F.lit(" "), F.col("task_text"))
        ),
    )


@query(
    "text_mismatches", "F10",
    with_sql("SELECT count(*) AS n_mismatched FROM statements_v WHERE task_id % 50 = 0", STATEMENTS_SQL),
)
def text_mismatches(spark, d):
    return X.text_mismatches(
        drifted(spark, d), statements_v(spark, d).select("task_id", "task_text"), "task_id", "task_text"
    )


@query(
    "aligned_join", "F10",
    "SELECT doc_id, lang, n_chars FROM documents",
)
def aligned_join(spark, d):
    doc = table(spark, d, "documents")
    left = doc.select("doc_id", "text", "lang")
    right = doc.select("doc_id", F.concat(F.col("text"), F.lit(" ")).alias("text"))
    joined = X.aligned_join(left, right, "doc_id", "text")
    return joined.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "first_head_of_division", "F12",
    with_sql(
        """SELECT nic2, arg_min(k, pos) AS head, sum(w) AS weight FROM (
             SELECT nic2, sum(weight) AS w FROM workers_v WHERE nic5 IS NOT NULL GROUP BY nic2)
           JOIN heads ON nic2 = nic GROUP BY nic2, w""".replace("sum(w) AS weight", "w AS weight"),
        WORKERS_SQL,
        "heads(k, pos, nic) AS (VALUES "
        + ", ".join(f"('{h}', {i}, '{n}')" for i, (h, ns) in enumerate(V.HEAD_DIVISIONS) for n in ns)
        + ")",
    ),
)
def first_head_of_division(spark, d):
    from weftspan.sources.maps import head_map

    sums = (
        workers_v(spark, d).filter(F.col("nic5").isNotNull())
        .groupBy(S.division_of().alias("nic2")).agg(F.sum("weight").alias("weight"))
    )
    return sums.join(X.first_head(head_map(spark, V.HEAD_DIVISIONS)), "nic2")


SECTOR_SQL = ranges_sql("sectors", V.SECTORS)


@query(
    "sector_of_division", "F13",
    with_sql(
        f"""SELECT nic2::INTEGER AS div, {first_range('nic2::INTEGER', 'sectors')} AS sector, sum(weight) AS weight
            FROM workers_v GROUP BY nic2""",
        WORKERS_SQL, SECTOR_SQL,
    ),
)
def sector_of_division(spark, d):
    sums = workers_v(spark, d).groupBy(S.division_of().try_cast("int").alias("div")).agg(
        F.sum("weight").alias("weight")
    )
    sectors = range_map(spark, V.SECTORS).withColumnRenamed("key", "sector")
    return sums.join(sectors, "div", "left").select("div", "sector", "weight")


@query(
    "recoded_titles", "F14",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' END AS title
       FROM orders""",
)
def recoded_titles(spark, d):
    titles = {"1-URGENT": "urgent", "2-HIGH": "high"}
    return table(spark, d, "orders").select(
        "o_orderkey", recode(F.col("o_orderpriority"), titles).alias("title")
    )


SPLIT_SQL = f"""agg AS (
  SELECT group3, TRY_CAST(nic2 AS INTEGER) AS nic_div, sum(weight) / 1e6 AS workers_m FROM workers_v GROUP BY ALL),
flagged AS (
  SELECT a.*, i.group3 IS NOT NULL AS indexed, {first_range('nic_div', 'sectors')} AS sector
  FROM agg a LEFT JOIN idx_v i ON a.group3 = i.group3)"""


@query(
    "sector_split", "F16",
    with_sql(
        """SELECT group3, sector, round(sum(workers_m), 7) AS workers_m FROM flagged
           WHERE indexed AND sector IS NOT NULL GROUP BY group3, sector""",
        LABELS_SQL, IDX_SQL, WORKERS_SQL, SECTOR_SQL, SPLIT_SQL,
    ),
)
def sector_split(spark, d):
    kept, _ = X.sector_split(S.headcount(workers_v(spark, d)), idx_v(spark, d), V.SECTORS)
    return kept.select("group3", "sector", r("workers_m", digits=7))


@query(
    "sector_left_out", "F16",
    with_sql(
        """SELECT round(coalesce(sum(workers_m) FILTER (NOT indexed), 0), 7) AS unindexed_m,
                  round(coalesce(sum(workers_m) FILTER (indexed AND sector IS NULL), 0), 7) AS unsectored_m FROM flagged""",
        LABELS_SQL, IDX_SQL, WORKERS_SQL, SECTOR_SQL, SPLIT_SQL,
    ),
)
def sector_left_out(spark, d):
    _, out = X.sector_split(S.headcount(workers_v(spark, d)), idx_v(spark, d), V.SECTORS)
    return out.select(r("unindexed_m", digits=7), r("unsectored_m", digits=7))


DRIFT_SQL = """halves AS (
  SELECT user_id AS nco_code, 'Brand#' || (user_id % 25)::VARCHAR AS group3, event_id % 2 AS half,
         CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'signup' THEN 0.5 WHEN 'view' THEN 0.0 END AS w
  FROM events),
betas AS (SELECT nco_code, group3, avg(w) FILTER (half = 0) AS o, avg(w) FILTER (half = 1) AS m FROM halves GROUP BY ALL),
other AS (SELECT p_brand AS group3, round(avg(p_size) / 50, 2) AS g FROM part GROUP BY p_brand),
drift AS (
  SELECT b.nco_code, b.group3, round(o, 3) AS beta_original, round(m, 3) AS beta_modern,
         round(m - o, 3) AS drift, g AS beta_group,
         CASE WHEN abs(g - round(o, 3)) > 0.05 THEN round(round(m - o, 3) / (g - round(o, 3)), 2) END AS gap_closure_share
  FROM betas b LEFT JOIN other USING (group3) WHERE o IS NOT NULL AND m IS NOT NULL)"""


def drift_v(spark, d):
    halves = labels_v(spark, d).filter(F.col("score").isNotNull())

    def beta(half, name):
        return beta_of_labels(
            halves.filter(F.col("task_id") % 2 == half), ["nco_code", "group3"], name=name
        ).drop("n_labels")

    other = table(spark, d, "part").groupBy(F.col("p_brand").alias("group3")).agg(
        (F.avg("p_size") / 50).alias("beta_other")
    )
    modern = beta(1, "beta_modern").drop("group3")
    return X.vintage_drift(beta(0, "beta_original"), modern, other)


@query(
    "vintage_drift", "F17 D8",
    with_sql(
        """SELECT nco_code, group3, round(beta_original, 3) AS beta_original, round(beta_modern, 3) AS beta_modern,
                  round(drift, 3) AS drift, beta_group FROM drift""",
        DRIFT_SQL,
    ),
)
def vintage_drift(spark, d):
    return drift_v(spark, d).select(
        "nco_code", "group3", "beta_original", "beta_modern", "drift", "beta_group"
    )


@query(
    "drift_summary", "F17",
    with_sql(
        """SELECT round(avg(drift), 4) AS mean_drift, round(avg(beta_original), 4) AS mean_original,
                  round(avg(beta_modern), 4) AS mean_modern, round(avg(gap_closure_share), 2) AS mean_closure FROM drift""",
        DRIFT_SQL,
    ),
)
def drift_summary(spark, d):
    out = X.drift_summary(drift_v(spark, d))
    return out.select(
        r("mean_drift", digits=4), r("mean_original", digits=4), r("mean_modern", digits=4),
        r("mean_closure", digits=2),
    )


@query(
    "layered_titles", "F18",
    """WITH a AS (SELECT doc_id AS id, min('label ' || quality::VARCHAR) AS t FROM labels GROUP BY 1),
            b AS (SELECT conv_id AS id, min(text) AS t FROM conversations GROUP BY 1)
       SELECT doc_id AS id, coalesce(a.t, b.t) AS t FROM documents LEFT JOIN a ON doc_id = a.id LEFT JOIN b ON doc_id = b.id""",
)
def layered_titles(spark, d):
    first = table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("t")
    )
    second = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("t"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return X.layered_lookup(rows, [first, second], "id", "t")


@query(
    "distinct_counts", "F19",
    with_sql(
        """SELECT count(DISTINCT group3) AS n_groups, count(DISTINCT nic2) AS n_divisions,
                  count(DISTINCT age) AS n_ages, count(DISTINCT state) AS n_states FROM workers_v""",
        WORKERS_SQL,
    ),
)
def distinct_counts(spark, d):
    return workers_v(spark, d, place=True).agg(
        F.count_distinct("group3").alias("n_groups"),
        F.count_distinct(S.division_of()).alias("n_divisions"),
        F.count_distinct("age").alias("n_ages"),
        F.count_distinct("state").alias("n_states"),
    )


@query(
    "section_by_state", "F13 H10",
    with_sql(
        f"""SELECT state, {first_range('nic2::INTEGER', 'sections')} AS section, sum(weight) AS weight,
                   round(sum(beta * weight) / sum(weight), 6) AS mean_beta FROM scored_v GROUP BY ALL""",
        MERGED_SQL, SECTION_SQL,
    ),
)
def section_by_state(spark, d):
    from weftspan.operators.cuts import scored, with_section

    return with_section(scored(merged_v(spark, d, place=True))).groupBy("state", "section").agg(
        F.sum("weight").alias("weight"), r(weighted_mean("beta", "weight"), "mean_beta")
    )
