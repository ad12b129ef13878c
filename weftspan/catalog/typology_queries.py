"""Group typology (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.surrogates import MERGED_SQL, idx_v, merged_v, with_sql
from weftspan.operators import typology as T
from weftspan.plans.storage import materialise
from weftspan.sources import fixed_values as V
from weftspan.sources.io import table

FEATURES_SQL = """med AS (SELECT group3, median(monthly_earnings) AS me FROM scored_v WHERE monthly_earnings > 0 GROUP BY group3),
raw_f AS (
  SELECT s.group3, sum(weight) / 1e6 AS workers_m, max(s.alpha) AS alpha, max(s.zeta - s.alpha) AS e2_share,
         sum(CASE WHEN edu_code BETWEEN 10 AND 13 THEN weight ELSE 0 END) / sum(weight) AS grad_share,
         sum(CASE WHEN sex_code = 2 THEN weight ELSE 0 END) / sum(weight) AS female_share,
         sum(CASE WHEN sector_code = 2 THEN weight ELSE 0 END) / sum(weight) AS urban_share,
         sum(CASE WHEN age BETWEEN 18 AND 29 THEN weight ELSE 0 END) / sum(weight) AS young_share, max(me) AS me
  FROM scored_v s LEFT JOIN med ON med.group3 = s.group3 WHERE s.n_tasks >= 5 GROUP BY s.group3),
feat AS (SELECT *, ln(coalesce(me, (SELECT median(me) FROM raw_f))) AS log_med_earn FROM raw_f)"""
NAMES = T.FEATURES
# A fixed assignment of groups to clusters, for what needs one as input.
CLUSTER_SQL = "substr(group3, 7)::INTEGER % 4"
STANDARD_SQL = FEATURES_SQL + """,
std AS (SELECT group3, """ + CLUSTER_SQL + " AS cluster, " + ", ".join(
    f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}" for f in NAMES
) + " FROM feat)"


def features_v(spark, d):
    return T.group_features(merged_v(spark, d), idx_v(spark, d))


def with_cluster(df):
    return df.withColumn("cluster", F.expr("substr(group3, 7)").cast("int") % 4)


@query("group_features", "R1 H21", with_sql(
    "SELECT group3, round(workers_m, 7) AS workers_m, " + ", ".join(f"round({f}, 6) AS {f}" for f in NAMES) + " FROM feat",
    MERGED_SQL, FEATURES_SQL))
def group_features(spark, d):
    return features_v(spark, d).select("group3", r("workers_m", digits=7), *[r(f) for f in NAMES])


@query("standardised_features", "R2", with_sql(
    "SELECT group3, " + ", ".join(f"round({f}, 6) AS {f}" for f in NAMES) + " FROM std", MERGED_SQL, STANDARD_SQL))
def standardised_features(spark, d):
    return T.standardise(features_v(spark, d), NAMES).select("group3", *[r(f) for f in NAMES])


DIMS = [f"v{i}" for i in range(64)]


@query("standardised_vectors", "R2",
    "SELECT vec_id, " + ", ".join(
        f"round((embedding[{i + 1}]::DOUBLE - avg(embedding[{i + 1}]::DOUBLE) OVER ()) / stddev_pop(embedding[{i + 1}]::DOUBLE) OVER (), 5) AS v{i}"
        for i in range(64)) + " FROM embeddings")
def standardised_vectors(spark, d):
    dims = DIMS
    points = table(spark, d, "embeddings").select(
        "vec_id", *[F.col("embedding")[int(v[1:])].cast("double").alias(v) for v in dims]
    )
    return T.standardise(points, dims).select("vec_id", *[r(v, digits=5) for v in dims])


ROUNDS_SQL = 120


def kmeans_sql(points: str, ks, restarts: int = T.RESTARTS, seed: int = V.SEED) -> str:
    """Tables of k-means from drawn starts over ``points`` (id, p): ``near`` has the
    cluster of each point for the best restart of each k, ``best`` its cost."""
    runs = f"(SELECT k, unnest(range({restarts})) AS run FROM (SELECT unnest([{', '.join(map(str, ks))}]) AS k))"
    ranked = "row_number() OVER (PARTITION BY c.k, c.run, x.id ORDER BY list_distance(x.p, c.centre), c.cluster) AS rn"
    return f"""draws AS (SELECT run, id, p, row_number() OVER (PARTITION BY run ORDER BY md5('{seed}-' || run || '|' || id::VARCHAR), id) - 1 AS cluster
  FROM {points}, (SELECT unnest(range({restarts})) AS run)),
rounds AS (
  SELECT 0 AS turn, r.k, r.run, d.cluster, d.p AS centre FROM {runs} r JOIN draws d ON d.run = r.run AND d.cluster < r.k
  UNION ALL
  SELECT turn + 1, k, run, cluster, list(mean ORDER BY dim) FROM (
    SELECT turn, k, run, cluster, dim, avg(v) AS mean FROM (
      SELECT turn, k, run, cluster, unnest(p) AS v, generate_subscripts(p, 1) AS dim FROM (
        SELECT c.turn, c.k, c.run, c.cluster, x.p, {ranked} FROM rounds c, {points} x WHERE c.turn < {ROUNDS_SQL}) WHERE rn = 1)
    GROUP BY ALL) GROUP BY turn, k, run, cluster),
placed AS (SELECT k, run, id, p, cluster, dist FROM (
  SELECT c.k, c.run, c.cluster, x.id, x.p, list_distance(x.p, c.centre) AS dist, {ranked} FROM rounds c, {points} x WHERE c.turn = {ROUNDS_SQL}) WHERE rn = 1),
costs AS (SELECT k, run, sum(dist * dist) AS cost FROM placed GROUP BY k, run),
best AS (SELECT k, run, cost FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(cost, 6), run) AS rn FROM costs) WHERE rn = 1),
firsts AS (SELECT k, cluster, row_number() OVER (PARTITION BY k ORDER BY least) - 1 AS number FROM (
  SELECT k, cluster, min(id) AS least FROM placed JOIN best USING (k, run) GROUP BY k, cluster)),
near AS (SELECT k, id, p, number AS cluster FROM placed JOIN best USING (k, run) JOIN firsts USING (k, cluster))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


VECTORS_SQL = "vectors AS (SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS p FROM embeddings)"


@query("kmeans_vectors", "R3", recursive(with_sql(
    "SELECT n.k::INTEGER AS k, n.cluster::INTEGER AS cluster, count(*) AS n, round(max(b.cost), 6) AS cost FROM near n JOIN best b ON b.k = n.k GROUP BY 1, 2",
    VECTORS_SQL, kmeans_sql("vectors", [4]))))
def kmeans_vectors(spark, d):
    """Cluster sizes and cost of the best of all restarts on raw vectors."""
    points = table(spark, d, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate(DIMS)]
    )
    best = T.kmeans(points, "vec_id", DIMS, [4], starts="drawn")[4]
    labelled = T.renumbered(T.assign(points, DIMS, best.centres), "vec_id")
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(best.k).alias("k"), "cluster", "n", F.lit(round(best.cost, 6)).alias("cost")
    )


CHOSEN_SQL = "std_points AS (SELECT group3 AS id, [" + ", ".join(NAMES) + "] AS p FROM std),\n" + kmeans_sql("std_points", range(3, 8)) + """,
sizes AS (SELECT k, cluster, count(*) AS n FROM near GROUP BY k, cluster),
dist AS (SELECT a.k, a.id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.p, b.p)) AS total FROM near a JOIN near b ON a.k = b.k GROUP BY ALL),
ab AS (SELECT d.k, id, own, max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
  FROM dist d JOIN sizes s ON s.k = d.k AND s.cluster = d.other GROUP BY ALL),
scores AS (SELECT k, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY k),
chosen AS (SELECT k FROM scores ORDER BY round(silhouette, 9) DESC, k LIMIT 1)"""


@query("chosen_typology", "R3 R4 R5", recursive(with_sql(
    "SELECT n.cluster::INTEGER AS cluster, count(*) AS n_groups, round(sum(workers_m), 7) AS workers_m, "
    + ", ".join(f"round(sum({f} * workers_m) / sum(workers_m), 3) AS {f}" for f in NAMES)
    + " FROM near n JOIN chosen c ON c.k = n.k JOIN std_raw f ON f.group3 = n.id GROUP BY 1",
    MERGED_SQL, STANDARD_SQL + ", std_raw AS (SELECT s.*, f.workers_m FROM std s JOIN feat f ON f.group3 = s.group3)", CHOSEN_SQL)))
def chosen_typology(spark, d):
    """Profiles of the groups at the number of clusters of highest silhouette."""
    points = T.standardise(materialise(features_v(spark, d), "features"), NAMES)
    clustered, _ = T.choose_clusters(points, "group3", NAMES, starts="drawn")
    return T.cluster_profiles(clustered, NAMES).withColumn("workers_m", r("workers_m", digits=7))


@query("silhouette_by_group", "R4", with_sql(
    """, dist AS (SELECT a.group3, a.cluster AS own, b.cluster AS other, sum(sqrt(""" + " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in NAMES) + """)) AS total
         FROM std a, std b GROUP BY ALL),
       sizes AS (SELECT cluster, count(*) AS n FROM std GROUP BY cluster),
       ab AS (SELECT group3, own, max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
                     min(CASE WHEN own <> other THEN total / n END) AS b
              FROM dist JOIN sizes ON other = cluster GROUP BY group3, own)
       SELECT group3, own AS cluster, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab""".replace(
        "GROUP BY ALL", "GROUP BY a.group3, a.cluster, b.cluster"),
    MERGED_SQL, STANDARD_SQL))
def silhouette_by_group(spark, d):
    points = with_cluster(T.standardise(features_v(spark, d), NAMES))
    return T.silhouette_values(points, "group3", "cluster", NAMES).withColumn(
        "silhouette", r("silhouette")
    )


@query("cluster_profiles", "R5", with_sql(
    f"SELECT {CLUSTER_SQL} AS cluster, count(*) AS n_groups, round(sum(workers_m), 7) AS workers_m, "
    + ", ".join(f"round(sum({f} * workers_m) / sum(workers_m), 3) AS {f}" for f in NAMES)
    + " FROM feat GROUP BY 1", MERGED_SQL, FEATURES_SQL))
def cluster_profiles(spark, d):
    return T.cluster_profiles(with_cluster(features_v(spark, d)), NAMES).withColumn(
        "workers_m", r("workers_m", digits=7)
    )


@query("largest_members", "R6", with_sql(
    f"""SELECT cluster, group3, round(workers_m, 7) AS workers_m, place FROM (
          SELECT {CLUSTER_SQL} AS cluster, group3, workers_m,
                 (row_number() OVER (PARTITION BY {CLUSTER_SQL} ORDER BY workers_m DESC, group3))::INTEGER AS place FROM feat) WHERE place <= 5""",
    MERGED_SQL, FEATURES_SQL))
def largest_members(spark, d):
    return T.largest_members(with_cluster(features_v(spark, d))).withColumn(
        "workers_m", r("workers_m", digits=7)
    )
