"""Sampling, ranking and apportionment (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.crosswalk_queries import SECTOR_SQL, SPLIT_SQL
from weftspan.catalog.surrogates import (
    CODE_SQL, IDX_SQL, LABELS_SQL, WORKERS_SQL, codes_of, idx_v, labels_v, with_sql, workers_v,
)
from weftspan.functions.numeric import grand_total
from weftspan.operators import crosswalk as X
from weftspan.operators import sampling as L
from weftspan.operators import survey as S
from weftspan.sources import fixed_values as V
from weftspan.sources.io import table

POOL_SQL = LABELS_SQL + """,
pool AS (SELECT task_id, score AS label, md5('42|' || task_id::VARCHAR) AS draw,
                md5('42s|' || task_id::VARCHAR) AS place
         FROM labels_v WHERE task_id % 11 <> 0),
sample_v AS (
  SELECT task_id, label, label AS stratum, place FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw, task_id) AS n FROM pool WHERE label IS NOT NULL)
  WHERE n <= 200
  UNION ALL SELECT task_id, label, 'unresolved', place FROM pool WHERE label IS NULL),
sheet_v AS (SELECT *, row_number() OVER (ORDER BY place, task_id) AS seq FROM sample_v)"""


def sample_v(spark, d):
    pool = labels_v(spark, d).select("task_id", F.col("score").alias("label"))
    earlier = pool.filter(F.col("task_id") % 11 == 0)
    return L.stratified_sample(pool, exclude=earlier)


@query("stratified_sample", "L1 F4", with_sql("SELECT task_id, label, stratum FROM sample_v", POOL_SQL))
def stratified_sample(spark, d):
    return sample_v(spark, d)


@query("seeded_shuffle", "L2", with_sql("SELECT seq, task_id FROM sheet_v", POOL_SQL))
def seeded_shuffle(spark, d):
    return L.seeded_shuffle(sample_v(spark, d), "task_id").select("seq", "task_id")


@query(
    "blind_sheet", "L3",
    with_sql(
        """SELECT seq, task_id, '' AS rating_1, '' AS rating_2, '' AS rating_3,
                  '' AS notes_1, '' AS notes_2, '' AS notes_3 FROM sheet_v""",
        POOL_SQL,
    ),
)
def blind_sheet(spark, d):
    return L.blind_sheet(L.seeded_shuffle(sample_v(spark, d), "task_id"), ["seq", "task_id"])


@query(
    "sheet_key", "L3",
    with_sql("SELECT seq, task_id, label AS model_label, stratum FROM sheet_v", POOL_SQL),
)
def sheet_key(spark, d):
    return L.sheet_key(L.seeded_shuffle(sample_v(spark, d), "task_id"))


def _remainder_sql(source: str, keys: str, item: str, weight: str, total: str, out: str, order: str) -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    return f"""{out}_q AS (SELECT *, CASE WHEN {total} > 0 AND sum({weight}) OVER ({by}) > 0
    THEN {weight} / sum({weight}) OVER ({by}) * {total} ELSE 0.0 END AS q FROM {source}),
{out}_f AS (SELECT *, floor(q) AS f, row_number() OVER ({by} ORDER BY q - floor(q) DESC, {weight} DESC, {order}) AS rn,
    {total} - sum(floor(q)) OVER ({by}) AS short FROM {out}_q),
{out} AS (SELECT *, (f + CASE WHEN rn <= short THEN 1 ELSE 0 END)::BIGINT AS n FROM {out}_f)"""


SHARES_SQL = WORKERS_SQL + """,
shares_v AS (SELECT group3, sum(weight) AS w FROM workers_v GROUP BY group3)"""


@query(
    "apportioned_groups", "L4",
    with_sql(
        "SELECT group3, w, n FROM seats",
        SHARES_SQL, _remainder_sql("shares_v", "", "group3", "w", "463", "seats", "group3"),
    ),
)
def apportioned_groups(spark, d):
    groups = workers_v(spark, d).groupBy("group3").agg(F.sum("weight").alias("w"))
    return L.largest_remainder(groups, "w", 463, "group3")


SQUARES_SQL = (
    SPLIT_SQL
    + """,
members AS (SELECT f.group3, f.sector, sum(f.workers_m) AS workers_m, max(i.beta) AS beta
  FROM flagged f JOIN idx_v i ON f.group3 = i.group3 WHERE indexed AND sector IS NOT NULL GROUP BY f.group3, f.sector),
by_sector AS (SELECT sector, sum(workers_m) AS sm, CASE sector WHEN 'agriculture' THEN 1 WHEN 'industry' THEN 2 ELSE 3 END AS pos,
  round_even((SELECT sum(workers_m) FROM members) / 0.001, 0) AS total FROM members GROUP BY sector),
"""
    + _remainder_sql("by_sector", "", "pos", "sm", "total", "sector_seats", "pos")
    + """,
placed AS (SELECT m.group3, m.sector, m.workers_m, m.beta, s.n AS sq,
  row_number() OVER (PARTITION BY m.sector ORDER BY coalesce(m.beta, 0) DESC, m.group3) AS place
  FROM members m JOIN sector_seats s ON m.sector = s.sector),
"""
    + _remainder_sql("placed", "sector", "place", "workers_m", "sq", "squares", "place")
)


def squares_v(spark, d):
    kept, _ = X.sector_split(S.headcount(workers_v(spark, d)), idx_v(spark, d), V.SECTORS)
    scores = idx_v(spark, d).select("group3", "beta")
    members = kept.join(scores, "group3")
    return members, L.two_stage_squares(members, ["agriculture", "industry", "services"], unit_m=0.001)


@query(
    "two_stage_squares", "L5",
    with_sql(
        "SELECT sector, group3, sq AS sector_squares, n, n = 0 AS is_small FROM squares",
        LABELS_SQL, IDX_SQL, WORKERS_SQL, SECTOR_SQL, SQUARES_SQL,
    ),
)
def two_stage_squares(spark, d):
    _, squares = squares_v(spark, d)
    return squares.select(
        "sector", "group3", "sector_squares", "n", (F.col("n") == 0).alias("is_small")
    )


@query(
    "square_rows", "L9",
    with_sql(
        "SELECT sector, group3, unnest(range(1, n + 1)) AS unit FROM squares WHERE n > 0",
        LABELS_SQL, IDX_SQL, WORKERS_SQL, SECTOR_SQL, SQUARES_SQL,
    ),
)
def square_rows(spark, d):
    _, squares = squares_v(spark, d)
    return L.unit_rows(squares).orderBy("sector", F.desc("beta")).select("sector", "group3", "unit")


@query(
    "sector_scores", "L10 H1",
    with_sql(
        """SELECT sector, round(sum(workers_m), 7) AS workers_m, round(sum(workers_m * beta) / sum(workers_m), 6) AS beta
           FROM members WHERE beta IS NOT NULL AND workers_m > 0 GROUP BY sector""",
        LABELS_SQL, IDX_SQL, WORKERS_SQL, SECTOR_SQL, SQUARES_SQL,
    ),
)
def sector_scores(spark, d):
    members, _ = squares_v(spark, d)
    return L.sector_scores(members).select("sector", r("workers_m", digits=7), r("beta"))


SLOTS_SQL = WORKERS_SQL + """,
g AS (SELECT group3, substr(group3, 7, 1) AS division, sum(weight) AS w FROM workers_v GROUP BY group3),
gs AS (SELECT group3, division, w, w / sum(w) OVER () AS share FROM g),
dv AS (SELECT division, sum(share) AS share, count(*) AS cap FROM gs GROUP BY division),
nn AS (SELECT least(12, sum(cap)) AS n FROM dv),
st AS (SELECT division, share, cap, share * n AS q, least(cap, greatest(1, floor(share * n)))::BIGINT AS start, n FROM dv, nn),
need AS (SELECT max(n) - sum(start) AS missing FROM st),
steps AS (
  SELECT division, q - j AS priority FROM st, need, unnest(range(start, cap)) t(j) WHERE missing > 0
  UNION ALL
  SELECT division, (start - j) - q FROM st, need, unnest(range(0, start - 1)) t(j) WHERE missing < 0),
taken AS (
  SELECT division, count(*) AS k FROM (SELECT division, row_number() OVER (ORDER BY priority DESC, division) AS rn FROM steps), need
  WHERE rn <= abs(missing) GROUP BY division),
slots AS (
  SELECT st.division, st.share, st.cap, (start + sign(missing) * coalesce(k, 0))::BIGINT AS slots
  FROM st CROSS JOIN need LEFT JOIN taken ON st.division = taken.division)"""


def slots_v(spark, d):
    groups = workers_v(spark, d).groupBy("group3").agg(F.sum("weight").alias("w"))
    shares = groups.select(
        "group3",
        F.substring("group3", 7, 1).alias("division"),
        (F.col("w") / grand_total("w")).alias("share"),
    )
    divisions = shares.groupBy("division").agg(
        F.sum("share").alias("share"), F.count(F.lit(1)).alias("cap")
    )
    return shares, L.allocate_slots(divisions, 12)


@query(
    "allocated_slots", "L6",
    with_sql("SELECT division, round(share, 6) AS share, cap, slots FROM slots", SLOTS_SQL),
)
def allocated_slots(spark, d):
    _, slots = slots_v(spark, d)
    return slots.select("division", r("share"), "cap", "slots")


@query(
    "top_by_slots", "L7",
    with_sql(
        """SELECT group3, division, round(share, 6) AS share FROM (
             SELECT gs.*, slots, row_number() OVER (PARTITION BY gs.division ORDER BY gs.share DESC, group3) AS rn
             FROM gs JOIN slots ON gs.division = slots.division) WHERE rn <= slots""",
        SLOTS_SQL,
    ),
)
def top_by_slots(spark, d):
    shares, slots = slots_v(spark, d)
    return L.top_by_slots(shares, slots).select("group3", "division", r("share"))


@query(
    "representative_entries", "L8",
    f"""WITH e AS (SELECT source AS group3, source || '-' || lang AS family, {CODE_SQL} AS nco_code FROM documents),
        f AS (SELECT group3, family, count(*) AS n_entries,
                     min(nco_code) FILTER (ends_with(nco_code, '00')) AS arch, min(nco_code) AS low FROM e GROUP BY ALL)
        SELECT group3, family, coalesce(arch, low) AS nco_code, n_entries FROM (
          SELECT *, row_number() OVER (PARTITION BY group3 ORDER BY n_entries DESC, family) AS rn FROM f) WHERE rn = 1""",
)
def representative_entries(spark, d):
    entries = table(spark, d, "documents").select(
        F.col("source").alias("group3"),
        F.concat_ws("-", "source", "lang").alias("family"),
        codes_of("doc_id").alias("nco_code"),
    )
    return L.representatives(entries, archetype="00")
