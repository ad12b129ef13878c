"""Survey projection (E) and weighted cuts (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.surrogates import (
    DIVISION_AT, MERGED_SQL, PAYROLL_SQL, WORKERS_SQL, idx_v, merged_v, payroll_v, with_sql,
    workers_raw, workers_v,
)
from weftspan.functions.numeric import weighted_mean
from weftspan.operators import crosswalk as X
from weftspan.operators import cuts as H
from weftspan.operators import survey as S
from weftspan.sources import fixed_values as V
from weftspan.sources.maps import activity_map, head_map

WC = f"substr(group3, {DIVISION_AT}, 1) IN ('1', '2', '3', '4')"


def merged_sql(body: str, *more: str) -> str:
    return with_sql(body, MERGED_SQL, *more)


def ranges_sql(name: str, ranges) -> str:
    rows = ", ".join(f"({i}, '{k}', {a}, {b})" for i, (k, a, b) in enumerate(ranges))
    return f"{name}(pos, k, lo, hi) AS (VALUES {rows})"


def first_range(div: str, name: str) -> str:
    return f"(SELECT arg_min(k, pos) FROM {name} WHERE {div} >= lo AND {div} < hi)"


@query(
    "exposure_by_region", "D2 E7 E8 H1 H2",
    merged_sql(
        """SELECT region, round(sum(beta * weight) / sum(CASE WHEN beta IS NOT NULL THEN weight END), 6) AS mean_beta,
                  round(sum(CASE WHEN beta >= 0.5 THEN weight ELSE 0 END) / sum(CASE WHEN beta IS NOT NULL THEN weight ELSE 0 END), 6) AS share_high,
                  round(sum(CASE WHEN beta IS NOT NULL THEN weight ELSE 0 END) / sum(weight), 6) AS coverage,
                  sum(weight) AS weight
           FROM merged_v GROUP BY region"""
    ),
)
def exposure_by_region(spark, d):
    return H.exposure_with_coverage(merged_v(spark, d, place=True), ["region"]).select(
        "region", r("mean_beta"), r("share_high"), r("coverage"), "weight"
    )


@query(
    "employed_records", "E1",
    with_sql(
        """SELECT status_code, count(*) AS n FROM workers_raw
           WHERE status_code IN (11, 12, 21, 31, 41, 51) GROUP BY status_code""",
        WORKERS_SQL,
    ),
)
def employed_records(spark, d):
    return S.employed(workers_raw(spark, d)).groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "derived_workers", "E2 E3 E4 E5",
    with_sql(
        """SELECT group3, nic2, nic5, age, weight, mult / no_qtr AS simple_weight,
                  round(monthly_earnings, 2) AS monthly_earnings, formal_proxy FROM workers_v""",
        WORKERS_SQL,
    ),
)
def derived_workers(spark, d):
    return workers_v(spark, d).select(
        "group3", S.division_of().alias("nic2"), "nic5", "age", "weight",
        S.simple_weight().alias("simple_weight"), r("monthly_earnings", digits=2), "formal_proxy",
    )


@query(
    "worker_domain_faults", "E6",
    with_sql(
        """SELECT count(*) FILTER (NOT coalesce(sex_code IN (1, 2, 3), false)) AS bad_sex,
                  count(*) FILTER (NOT coalesce(age BETWEEN 0 AND 120, false)) AS bad_age,
                  count(*) FILTER (NOT coalesce(sector_code IN (1, 2), false)) AS bad_sector,
                  count(*) FILTER (NOT coalesce(weight > 0, false)) AS bad_weight FROM workers_v""",
        WORKERS_SQL,
    ),
)
def worker_domain_faults(spark, d):
    return S.worker_faults(workers_v(spark, d))


@query(
    "index_on_workers", "E7 F2",
    merged_sql(
        """SELECT group3, count(*) AS n, count(beta) AS n_matched, round(max(beta), 6) AS beta
           FROM merged_v GROUP BY group3"""
    ),
)
def index_on_workers(spark, d):
    return merged_v(spark, d).groupBy("group3").agg(
        F.count(F.lit(1)).alias("n"), F.count("beta").alias("n_matched"), r(F.max("beta"), "beta")
    )


@query(
    "match_coverage", "E8 G2",
    merged_sql(
        """SELECT count(*) AS n_workers, sum(weight) AS weight_total,
                  sum(CASE WHEN beta IS NOT NULL THEN weight ELSE 0 END) AS weight_matched,
                  round(sum(CASE WHEN beta IS NOT NULL THEN weight ELSE 0 END) / sum(weight), 6) AS coverage,
                  CASE WHEN sum(CASE WHEN beta IS NOT NULL THEN weight ELSE 0 END) / sum(weight) >= 0.9
                       THEN 'PASS' ELSE 'FAIL' END AS verdict FROM merged_v"""
    ),
)
def match_coverage(spark, d):
    from weftspan.operators.contracts import gate

    covered = gate(S.match_coverage(merged_v(spark, d)), "coverage", minimum=V.MIN_COVERAGE, name="verdict")
    return covered.withColumn("coverage", r("coverage"))


@query(
    "unmatched_groups", "E8",
    merged_sql(
        """SELECT group3, sum(weight) AS weight,
                  round(sum(weight) / (SELECT sum(weight) FROM merged_v), 6) AS emp_share
           FROM merged_v WHERE beta IS NULL GROUP BY group3"""
    ),
)
def unmatched_groups(spark, d):
    return S.unmatched_groups(merged_v(spark, d)).select("group3", "weight", r("emp_share"))


@query(
    "employment_shares", "E9",
    with_sql(
        """SELECT group3, sum(weight) AS w, round(sum(weight) / sum(sum(weight)) OVER (), 6) AS share,
                  substr(group3, 1, 1) AS division FROM workers_v GROUP BY group3""",
        WORKERS_SQL,
    ),
)
def employment_shares(spark, d):
    return S.employment_shares(workers_v(spark, d)).select("group3", "w", r("share"), "division")


@query(
    "headcount_by_division", "E10",
    with_sql(
        """SELECT group3, TRY_CAST(nic2 AS INTEGER) AS nic_div, round(sum(weight) / 1e6, 7) AS workers_m
           FROM workers_v GROUP BY ALL""",
        WORKERS_SQL,
    ),
)
def headcount_by_division(spark, d):
    return S.headcount(workers_v(spark, d)).select("group3", "nic_div", r("workers_m", digits=7))


@query(
    "overall_exposure", "H1 H2",
    merged_sql(
        """SELECT round(sum(beta * weight) / sum(weight), 6) AS mean_beta,
                  round(sum(CASE WHEN beta >= 0.5 THEN weight ELSE 0 END) / sum(weight), 6) AS share_high,
                  sum(weight) AS weight FROM scored_v"""
    ),
)
def overall_exposure(spark, d):
    return H.exposure_summary(merged_v(spark, d)).select(r("mean_beta"), r("share_high"), "weight")


@query(
    "wage_bill_share", "H2 H3",
    merged_sql(
        """SELECT round(sum(CASE WHEN beta >= 0.5 THEN weight ELSE 0 END) / sum(weight), 6) AS headcount_share,
                  round(sum(CASE WHEN beta >= 0.5 THEN bill END) / sum(bill), 6) AS wage_bill_share
           FROM scored_v"""
    ),
)
def wage_bill_share(spark, d):
    return H.wage_bill_share(merged_v(spark, d)).select(r("headcount_share"), r("wage_bill_share"))


AGE_SQL = ranges_sql("bands", [(f"{a}-{b}", a, b + 1) for a, b in V.AGE_BANDS])


@query(
    "entry_rung", "H4",
    merged_sql(
        f"""SELECT k AS age_band, segment, round(sum(beta * weight) / sum(weight), 6) AS mean_beta,
                  round(sum(CASE WHEN beta >= 0.5 THEN weight ELSE 0 END) / sum(weight), 6) AS share_hi_exposure,
                  sum(weight) AS emp_weight_share
           FROM (SELECT *, 'all_workers' AS segment FROM scored_v
                 UNION ALL SELECT *, 'white_collar' FROM scored_v WHERE {WC}) s
           JOIN bands ON age >= lo AND age < hi GROUP BY k, segment""",
        AGE_SQL,
    ),
)
def entry_rung(spark, d):
    return H.entry_rung(merged_v(spark, d), division_at=DIVISION_AT).select(
        "age_band", "segment", r("mean_beta"), r("share_hi_exposure"), "emp_weight_share"
    )


@query(
    "score_histogram", "H5",
    merged_sql(
        """SELECT pos AS bin_no, k AS bin,
                  round(coalesce(sum(weight), 0) / (SELECT sum(weight) FROM scored_v) * 100, 6) AS pct
           FROM bins LEFT JOIN scored_v ON beta >= lo AND beta < hi GROUP BY pos, k""",
        "bins(pos, k, lo, hi) AS (VALUES "
        + ", ".join(f"({i}, '{k}', {a}::DOUBLE, {b}::DOUBLE)" for i, (k, a, b) in enumerate(V.SCORE_BINS))
        + ")",
    ),
)
def score_histogram(spark, d):
    return H.score_histogram(merged_v(spark, d)).select("bin_no", "bin", r("pct"))


@query(
    "education_cut", "H6",
    merged_sql(
        """SELECT label AS education,
                  round(sum(weight) / (SELECT sum(weight) FROM scored_v) * 100, 6) AS pct,
                  round(sum(beta * weight) / sum(weight), 6) AS mean_beta
           FROM scored_v JOIN edu ON edu_code = code GROUP BY label""",
        "edu(label, code) AS (VALUES "
        + ", ".join(f"('{k}', {c})" for k, codes in V.EDUCATION for c in codes)
        + ")",
    ),
)
def education_cut(spark, d):
    return H.education_cut(merged_v(spark, d)).select("education", r("pct"), r("mean_beta"))


def _sex_sql(where: str, code: int) -> str:
    return (
        f"(SELECT round(sum(beta * weight) / sum(weight), 6) FROM scored_v WHERE sex_code = {code} AND {where})"
    )


ORGANISED = "sector_code = 2 AND formal_proxy"


@query(
    "gender_by_organised", "H7",
    merged_sql(
        f"""SELECT 'all' AS segment, {_sex_sql('true', 1)} AS men, {_sex_sql('true', 2)} AS women
            UNION ALL SELECT 'organised', {_sex_sql(ORGANISED, 1)}, {_sex_sql(ORGANISED, 2)}"""
    ),
)
def gender_by_organised(spark, d):
    return H.gender_by_organised(merged_v(spark, d)).select("segment", r("men"), r("women"))


@query(
    "white_collar_high_by_age", "H8",
    merged_sql(
        f"""SELECT k AS age_band,
                   round(sum(CASE WHEN beta >= 0.5 THEN weight ELSE 0 END) / sum(weight) * 100, 6) AS hi_pct,
                   round((SELECT sum(CASE WHEN beta >= 0.5 THEN weight ELSE 0 END) / sum(weight) * 100
                          FROM scored_v WHERE {WC}), 6) AS segment_pct
            FROM scored_v JOIN bands ON age >= lo AND age < hi
            WHERE {WC} AND pos BETWEEN 1 AND 8 GROUP BY k""",
        AGE_SQL,
    ),
)
def white_collar_high_by_age(spark, d):
    return H.white_collar_high_by_age(merged_v(spark, d), division_at=DIVISION_AT).select(
        "age_band", r("hi_pct"), r("segment_pct")
    )


@query(
    "state_ranking", "H9",
    merged_sql(
        """, states AS (SELECT state, sum(beta * weight) / sum(weight) AS m, sum(weight) AS w FROM scored_v GROUP BY state),
           kept AS (SELECT * FROM states WHERE w / (SELECT sum(w) FROM states) > 0.005)
           SELECT * FROM (SELECT state, round(m, 6) AS mean_beta, w, 'top' AS side,
                                 (row_number() OVER (ORDER BY m DESC, state))::INTEGER AS place FROM kept) WHERE place <= 8
           UNION ALL
           SELECT * FROM (SELECT state, round(m, 6), w, 'bottom',
                                 (row_number() OVER (ORDER BY m, state DESC))::INTEGER AS place FROM kept) WHERE place <= 4"""
    ),
)
def state_ranking(spark, d):
    return H.state_ranking(merged_v(spark, d, place=True)).select(
        "state", r("mean_beta"), "w", "side", "place"
    )


SECTION_SQL = ranges_sql("sections", V.SECTIONS)
SECTIONED = f"(SELECT *, {first_range('TRY_CAST(nic2 AS INTEGER)', 'sections')} AS section FROM scored_v)"


@query(
    "section_means", "H10 F13",
    merged_sql(
        f"""SELECT section, round(sum(beta * weight) / sum(weight), 6) AS mean_beta,
                   round(sum(weight) / 1e6, 7) AS workers_m
            FROM {SECTIONED} WHERE section IS NOT NULL GROUP BY section HAVING sum(weight) / 1e6 > 0.01""",
        SECTION_SQL,
    ),
)
def section_means(spark, d):
    return H.section_means(merged_v(spark, d), min_workers_m=0.01).select(
        "section", r("mean_beta"), r("workers_m", digits=7)
    )


@query(
    "top_groups", "H11",
    merged_sql(
        """SELECT group3, round(sum(beta * weight) / sum(weight), 6) AS mean_beta,
                  round(sum(weight) / 1e6, 7) AS workers_m
           FROM scored_v GROUP BY group3 HAVING sum(weight) / 1e6 >= 0.001
           ORDER BY sum(beta * weight) / sum(weight) DESC, group3 LIMIT 10"""
    ),
)
def top_groups(spark, d):
    return H.top_groups(merged_v(spark, d), min_workers_m=0.001).select(
        "group3", r("mean_beta"), r("workers_m", digits=7)
    )


@query(
    "section_wage_bill", "H12",
    merged_sql(
        f"""SELECT section, round(sum(bill) / 1e10, 6) AS wb_units,
                   round(sum(CASE WHEN beta >= 0.5 THEN bill ELSE 0 END) / sum(bill) * 100, 6) AS hi_pct,
                   round(sum(CASE WHEN beta >= 0.5 THEN weight ELSE 0 END) / 1e6, 7) AS hi_workers_m,
                   round((SELECT sum(CASE WHEN beta >= 0.5 THEN bill END) / sum(bill) * 100
                          FROM {SECTIONED} WHERE bill IS NOT NULL AND section IS NOT NULL), 6) AS economy_pct
            FROM {SECTIONED} WHERE bill IS NOT NULL AND section IS NOT NULL
            GROUP BY section HAVING sum(bill) / 1e10 > 0.01
            ORDER BY sum(CASE WHEN beta >= 0.5 THEN bill ELSE 0 END) / sum(bill) DESC, section LIMIT 10""",
        SECTION_SQL,
    ),
)
def section_wage_bill(spark, d):
    return H.section_wage_bill(merged_v(spark, d), min_units=0.01).select(
        "section", r("wb_units"), r("hi_pct"), r("hi_workers_m", digits=7), r("economy_pct")
    )


@query(
    "top_index_groups", "H13",
    merged_sql(
        """SELECT s.group3, round(i.beta, 6) AS beta, round(sum(weight) / 1e6, 7) AS workers_m
           FROM scored_v s JOIN idx_v i ON s.group3 = i.group3 WHERE i.n_tasks >= 5
           GROUP BY s.group3, i.beta ORDER BY i.beta DESC, s.group3 LIMIT 10"""
    ),
)
def top_index_groups(spark, d):
    return H.top_index_groups(merged_v(spark, d), idx_v(spark, d)).select(
        "group3", r("beta"), r("workers_m", digits=7)
    )


def _bubble_sql(where: str) -> str:
    return merged_sql(
        f"""SELECT s.group3, round(sum(weight) / 1e6, 7) AS workers_m,
                   round(coalesce(sum(bill) / (SELECT sum(bill) FROM scored_v) * 100, 0), 6) AS wb_pct,
                   round(max(i.beta), 6) AS beta
            FROM scored_v s JOIN idx_v i ON s.group3 = i.group3
            WHERE i.n_tasks >= 5 AND {where} GROUP BY s.group3 HAVING sum(weight) / 1e6 > 0.0001"""
    )


@query("bubble_frame", "H14", _bubble_sql("true"))
def bubble_frame(spark, d):
    return H.bubble_frame(merged_v(spark, d), idx_v(spark, d), min_workers_m=0.0001).select(
        "group3", r("workers_m", digits=7), r("wb_pct"), r("beta")
    )


@query("bubble_frame_white_collar", "H14", _bubble_sql(WC.replace("group3", "s.group3")))
def bubble_frame_white_collar(spark, d):
    return H.bubble_frame(
        merged_v(spark, d), idx_v(spark, d), True, min_workers_m=0.0001, division_at=DIVISION_AT
    ).select("group3", r("workers_m", digits=7), r("wb_pct"), r("beta"))


ACTIVITY_SQL = (
    "activities(label, val, lo, hi) AS (VALUES "
    + ", ".join(f"('{k}', {v}, {a}, {b})" for k, v, ranges in V.ACTIVITIES for a, b in ranges)
    + """),
bridge AS (SELECT label, val, sum(beta * weight) / sum(weight) AS m, coalesce(sum(weight), 0) / 1e6 AS workers_m
  FROM activities LEFT JOIN scored_v ON nic2::INTEGER >= lo AND nic2::INTEGER < hi GROUP BY label, val)"""
)


@query(
    "activity_bridge", "H15",
    merged_sql(
        "SELECT label, val AS value, round(m, 6) AS mean_beta, round(workers_m, 7) AS workers_m FROM bridge",
        ACTIVITY_SQL,
    ),
)
def activity_bridge(spark, d):
    sums = H.division_sums(merged_v(spark, d), DIVISION_AT)
    return H.activity_bridge(sums, activity_map(spark, V.ACTIVITIES)).select(
        "label", F.col("value").cast("int").alias("value"), r("mean_beta"), r("workers_m", digits=7)
    )


@query(
    "value_weighted_exposure", "H15",
    merged_sql(
        f"""SELECT round(sum(val / {V.ACTIVITY_TOTAL} * m), 6) AS value_weighted_beta,
                   round(sum(CASE WHEN m > (SELECT sum(beta * weight) / sum(weight) FROM scored_v WHERE nic5 IS NOT NULL)
                             THEN val / {V.ACTIVITY_TOTAL} ELSE 0 END), 6) AS exposed_value_share
            FROM bridge""",
        ACTIVITY_SQL,
    ),
)
def value_weighted_exposure(spark, d):
    sums = H.division_sums(merged_v(spark, d), DIVISION_AT)
    bridge = H.activity_bridge(sums, activity_map(spark, V.ACTIVITIES))
    return H.value_weighted(bridge).select(
        r("value_weighted_beta"), r("exposed_value_share")
    )


def _weight_sql(w: float) -> str:
    s = f"(alpha + {w} * (zeta - alpha))"
    return f"""SELECT {w}::DOUBLE AS e2_weight, round(sum({s} * weight) / sum(weight), 6) AS mean_emp_weighted,
        round(sum({s} * bill) / sum(bill), 6) AS mean_wagebill_weighted,
        round(sum(CASE WHEN {s} >= 0.5 THEN weight ELSE 0 END) / sum(weight) * 100, 6) AS hi_worker_pct,
        round(sum(CASE WHEN {s} >= 0.5 THEN bill ELSE 0 END) / sum(bill) * 100, 6) AS hi_earnings_pct
        FROM scored_v"""


@query(
    "weight_sensitivity", "H16 D5",
    merged_sql(" UNION ALL ".join(_weight_sql(w) for w in (0.0, 0.5, 1.0))),
)
def weight_sensitivity(spark, d):
    return H.weight_sensitivity(merged_v(spark, d)).select(
        "e2_weight", r("mean_emp_weighted"), r("mean_wagebill_weighted"), r("hi_worker_pct"),
        r("hi_earnings_pct"),
    )


@query(
    "top_overlap", "H16 F6",
    merged_sql(
        """, low AS (SELECT group3 FROM idx_v WHERE n_tasks >= 5 ORDER BY alpha DESC, group3 LIMIT 10),
           high AS (SELECT group3 FROM idx_v WHERE n_tasks >= 5 ORDER BY alpha + 1.0 * (zeta - alpha) DESC, group3 LIMIT 10)
           SELECT group3, CASE WHEN l.group3 IS NULL THEN 'high_only' WHEN h.group3 IS NULL THEN 'low_only' ELSE 'both' END AS kind
           FROM low l FULL JOIN high h USING (group3)"""
    ),
)
def top_overlap(spark, d):
    return H.top_overlap(idx_v(spark, d))


HEAD_SQL = (
    "heads(head, pos, nic) AS (VALUES "
    + ", ".join(f"('{h}', {i}, '{n}')" for i, (h, ns) in enumerate(V.HEAD_DIVISIONS) for n in ns)
    + ")"
)
HEAD_WORKERS = "scored_v JOIN heads ON nic2 = nic"
HEAD_MEANS_SQL = f"""head_means AS (
  SELECT head, sum(beta * weight) / sum(weight) AS m, sum(weight) AS w
  FROM {HEAD_WORKERS} GROUP BY head)"""


def head_scores(spark, d):
    sums = H.division_sums(merged_v(spark, d), DIVISION_AT)
    return X.head_profile(sums, head_map(spark, V.HEAD_DIVISIONS))


@query(
    "head_profile", "H17 F11 A6",
    merged_sql(
        f"""SELECT head AS industry,
                   (SELECT string_agg(DISTINCT nic2, '+' ORDER BY nic2) FROM {HEAD_WORKERS} WHERE head = o.head) AS nic2,
                   round(w / 1e6, 7) AS workers_m, round(m, 6) AS mean_beta,
                   round((SELECT sqrt(sum((beta - o.m) * (beta - o.m) * weight) / sum(weight)) FROM {HEAD_WORKERS} WHERE head = o.head), 6) AS sd_within,
                   round((SELECT sum(CASE WHEN beta >= 0.5 THEN weight ELSE 0 END) / sum(weight) FROM {HEAD_WORKERS} WHERE head = o.head), 6) AS share_hi,
                   round((SELECT sum(CASE WHEN {WC} THEN weight ELSE 0 END) / sum(weight) FROM {HEAD_WORKERS} WHERE head = o.head), 6) AS share_white_collar
            FROM head_means o""",
        HEAD_SQL, HEAD_MEANS_SQL,
    ),
)
def head_profile(spark, d):
    return head_scores(spark, d).select(
        "industry", "nic2", r("workers_m", digits=7), r("mean_beta"), r("sd_within"),
        r("share_hi"), r("share_white_collar"),
    )


@query(
    "head_volumes", "H18",
    with_sql(
        """SELECT industry, sum(abs(value))::BIGINT AS abs_volume, sum(value)::BIGINT AS net_total
           FROM payroll_v WHERE industry IS NOT NULL GROUP BY industry""",
        PAYROLL_SQL,
    ),
)
def head_volumes(spark, d):
    return X.head_volumes(payroll_v(spark, d))


@query(
    "volume_weighted_heads", "H18",
    merged_sql(
        """, vol AS (SELECT industry, sum(abs(value)) AS v FROM payroll_v WHERE industry IS NOT NULL GROUP BY industry),
           j AS (SELECT m, coalesce(v, 0) AS v FROM head_means LEFT JOIN vol ON head = industry),
           t AS (SELECT sum(m * v) / sum(v) AS mu FROM j)
           SELECT round(max(mu), 6) AS weighted_mean,
                  round(sqrt(sum(v * (m - mu) * (m - mu)) / sum(v)), 6) AS weighted_sd FROM j, t""",
        HEAD_SQL, HEAD_MEANS_SQL, PAYROLL_SQL,
    ),
)
def volume_weighted_heads(spark, d):
    return X.volume_weighted(head_scores(spark, d), X.head_volumes(payroll_v(spark, d))).select(
        r("weighted_mean"), r("weighted_sd")
    )


@query(
    "variance_share", "H19 F12",
    merged_sql(
        """, first AS (SELECT nic, arg_min(head, pos) AS head FROM heads GROUP BY nic),
           mw AS (SELECT beta, weight, head FROM scored_v JOIN first ON nic2 = nic),
           g AS (SELECT sum(beta * weight) / sum(weight) AS gm FROM mw),
           hm AS (SELECT head, sum(beta * weight) / sum(weight) AS hb, sum(weight) AS hw FROM mw GROUP BY head)
           SELECT round((SELECT sum((hb - gm) * (hb - gm) * hw) / sum(hw) FROM hm, g) /
                        (SELECT sum((beta - gm) * (beta - gm) * weight) / sum(weight) FROM mw, g), 6) AS eta2,
                  round((SELECT sum(weight) FROM mw) / (SELECT sum(weight) FROM scored_v WHERE nic5 IS NOT NULL), 6) AS mapped_share""",
        HEAD_SQL,
    ),
)
def variance_share(spark, d):
    sums = H.division_sums(merged_v(spark, d), DIVISION_AT)
    return X.variance_share(sums, head_map(spark, V.HEAD_DIVISIONS)).select(
        r("eta2"), r("mapped_share")
    )


@query(
    "index_quartiles", "H20",
    merged_sql(
        """, s AS (SELECT list_sort(list(m)) AS v FROM head_means)
           SELECT len(v) AS n, round(v[1], 6) AS low, round(v[-1], 6) AS high,
                  round(v[len(v) // 4 + 1], 6) AS q1, round(v[3 * len(v) // 4 + 1], 6) AS q3 FROM s""",
        HEAD_SQL, HEAD_MEANS_SQL,
    ),
)
def index_quartiles(spark, d):
    return X.index_quartiles(head_scores(spark, d)).select(
        "n", r("low"), r("high"), r("q1"), r("q3")
    )


@query(
    "median_earnings", "H21",
    merged_sql(
        """SELECT group3, round(median(monthly_earnings), 6) AS med_earn FROM scored_v
           WHERE monthly_earnings > 0 GROUP BY group3"""
    ),
)
def median_earnings(spark, d):
    return H.median_earnings(merged_v(spark, d)).select("group3", r("med_earn"))


@query(
    "gender_decomposition", "H1 H7",
    merged_sql(
        """SELECT sex_code, group3, sum(weight) AS w, round(sum(beta * weight) / sum(weight), 6) AS mean_beta
           FROM scored_v GROUP BY sex_code, group3"""
    ),
)
def gender_decomposition(spark, d):
    return H.scored(merged_v(spark, d)).groupBy("sex_code", "group3").agg(
        F.sum("weight").alias("w"), r(weighted_mean("beta", "weight"), "mean_beta")
    )
