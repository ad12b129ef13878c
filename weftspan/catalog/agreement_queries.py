"""Agreement statistics (K) over synthetic raters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query, r
from weftspan.catalog.surrogates import NOTES, RATERS, RATERS_SQL, raters_v, with_sql
from weftspan.functions.labels import LABELS, clean_label
from weftspan.operators import agreement as K
from weftspan.operators.contracts import gate
from weftspan.sources.fixed_values import MIN_KAPPA

PAIRS_SQL = RATERS_SQL + """,
pairs_v AS (SELECT task_id, upper(trim(rating_1)) AS human, coalesce(model, 'TIE') AS model, stratum FROM raters_v),
usable_v AS (SELECT * FROM pairs_v WHERE human IN ('E0','E1','E2') AND model IN ('E0','E1','E2')),
majority_v AS (
  SELECT *, CASE WHEN n > 0 AND (c0 = top)::INT + (c1 = top)::INT + (c2 = top)::INT = 1
                 THEN CASE WHEN c0 = top THEN 'E0' WHEN c1 = top THEN 'E1' ELSE 'E2' END END AS majority
  FROM (SELECT *, greatest(c0, c1, c2) AS top, c0 + c1 + c2 AS n
        FROM (SELECT *, """ + ", ".join(
    f"coalesce((r1 = '{x}')::INT, 0) + coalesce((r2 = '{x}')::INT, 0) + coalesce((r3 = '{x}')::INT, 0) AS c{i}"
    for i, x in enumerate(LABELS)
) + " FROM clean_v)))"


def pairs_v(spark, d):
    return raters_v(spark, d).select(
        "task_id",
        clean_label("rating_1").alias("human"),
        F.coalesce("model", F.lit("TIE")).alias("model"),
        "stratum",
    )


def _kappa_sql(a: str, b: str, source: str) -> str:
    """Kappa from label lists: agreement rate and products of marginals."""
    marginals = " + ".join(
        f"(count(*) FILTER ({a} = '{x}') / count(*)) * (count(*) FILTER ({b} = '{x}') / count(*))" for x in LABELS
    )
    return f"""SELECT n_pairs, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa
        FROM (SELECT count(*) AS n_pairs, count(*) FILTER ({a} = {b}) / count(*) AS po, {marginals} AS pe FROM {source})"""


def _kappa(df, *more):
    return df.select(*more, "n_pairs", r("po"), r("pe"), r("kappa"))


@query(
    "normalised_ratings", "K1",
    with_sql("SELECT human, count(*) AS n FROM pairs_v GROUP BY human", PAIRS_SQL),
)
def normalised_ratings(spark, d):
    return pairs_v(spark, d).groupBy("human").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rating_partition", "K2",
    with_sql(
        """SELECT count(*) AS n_rows, (SELECT count(*) FROM usable_v) AS n_usable,
                  count(*) FILTER (model = 'TIE') AS n_ties,
                  count(*) FILTER (human IS NOT NULL AND human <> '' AND human NOT IN ('E0','E1','E2')) AS n_invalid,
                  count(*) FILTER (human IS NULL OR human = '') AS n_blank FROM pairs_v""",
        PAIRS_SQL,
    ),
)
def rating_partition(spark, d):
    return K.partition_counts(pairs_v(spark, d))


@query(
    "confusion_matrix", "K3",
    with_sql(
        """SELECT h.x AS human, """
        + ", ".join(f"count(*) FILTER (u.model = '{m}') AS model_{m}" for m in LABELS)
        + " FROM (VALUES ('E0'), ('E1'), ('E2')) h(x) LEFT JOIN usable_v u ON u.human = h.x GROUP BY h.x",
        PAIRS_SQL,
    ),
)
def confusion_matrix(spark, d):
    return K.confusion_matrix(pairs_v(spark, d))


@query("cohen_kappa", "K4", with_sql(_kappa_sql("human", "model", "usable_v"), PAIRS_SQL))
def cohen_kappa(spark, d):
    return _kappa(K.cohen_kappa(pairs_v(spark, d)))


@query(
    "kappa_by_stratum", "K4 K8",
    with_sql(
        """SELECT stratum, count(*) AS n_pairs, round(count(*) FILTER (human = model) / count(*), 6) AS po
           FROM usable_v GROUP BY stratum""",
        PAIRS_SQL,
    ),
)
def kappa_by_stratum(spark, d):
    out = K.cohen_kappa(pairs_v(spark, d), keys=["stratum"])
    return out.filter(F.col("n_pairs") > 0).select("stratum", "n_pairs", r("po"))


def _rater_sql(i: int) -> str:
    use = f"(SELECT * FROM clean_v WHERE r{i} IN ('E0','E1','E2') AND model IS NOT NULL)"
    counts = ", ".join(f"(SELECT count(*) FROM {use} WHERE r{i} = '{x}') AS count_{x.lower()}" for x in LABELS)
    return f"""SELECT 'rating_{i}' AS rater, (SELECT count(*) FROM clean_v WHERE r{i} IS NULL) AS blank,
        (SELECT count(*) FROM clean_v WHERE r{i} = 'NA') AS na, {counts}, k.*
        FROM ({_kappa_sql(f'r{i}', 'model', use)}) k"""


@query(
    "rater_agreement", "K5",
    with_sql(" UNION ALL ".join(_rater_sql(i) for i in (1, 2, 3)), PAIRS_SQL),
)
def rater_agreement(spark, d):
    return _kappa(
        K.per_rater(raters_v(spark, d), RATERS),
        "rater", "blank", "na", "count_e0", "count_e1", "count_e2",
    )


MAJ = "(SELECT * FROM majority_v WHERE majority IS NOT NULL AND model IS NOT NULL)"


@query(
    "majority_ratings", "K6",
    with_sql(
        "SELECT majority, n AS n_labels, count(*) AS items FROM majority_v GROUP BY majority, n", PAIRS_SQL
    ),
)
def majority_ratings(spark, d):
    return K.with_majority(raters_v(spark, d), RATERS).groupBy("majority", "n_labels").agg(
        F.count(F.lit(1)).alias("items")
    )


@query(
    "majority_vs_model", "K6 K13 G2",
    with_sql(
        f"""SELECT *, CASE WHEN kappa >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS gate,
                   (SELECT count(*) FROM majority_v WHERE n > 0 AND majority IS NULL) AS ties_excluded
            FROM ({_kappa_sql('majority', 'model', MAJ)})""",
        PAIRS_SQL,
    ),
)
def majority_vs_model(spark, d):
    out = K.majority_vs_model(raters_v(spark, d), RATERS)
    return _kappa(gate(out, "kappa", minimum=MIN_KAPPA), "ties_excluded", "gate")


@query(
    "fleiss_kappa", "K7",
    with_sql(
        """SELECT n_items, round(p_bar, 6) AS p_bar, round(pe, 6) AS pe, round((p_bar - pe) / (1 - pe), 6) AS kappa
           FROM (SELECT count(*) AS n_items, avg((c0 * c0 + c1 * c1 + c2 * c2 - 3) / 6.0) AS p_bar,
                        pow(sum(c0) / (3.0 * count(*)), 2) + pow(sum(c1) / (3.0 * count(*)), 2) + pow(sum(c2) / (3.0 * count(*)), 2) AS pe
                 FROM majority_v WHERE n = 3)""",
        PAIRS_SQL,
    ),
)
def fleiss_kappa(spark, d):
    return K.fleiss_kappa(raters_v(spark, d), RATERS).select("n_items", r("p_bar"), r("pe"), r("kappa"))


@query(
    "agreement_by_stratum", "K8",
    with_sql(
        f"""SELECT stratum, count(*) AS n, count(*) FILTER (majority = model) AS agree,
                   round(count(*) FILTER (majority = model) / count(*), 6) AS pct FROM {MAJ} GROUP BY stratum""",
        PAIRS_SQL,
    ),
)
def agreement_by_stratum(spark, d):
    return K.agreement_by_stratum(raters_v(spark, d), RATERS).select("stratum", "n", "agree", r("pct"))


@query(
    "note_tags", "K9",
    with_sql(
        """SELECT tag, count(*) AS n
           FROM (SELECT unnest([notes_1, notes_2, notes_3]) AS note FROM raters_v),
                (VALUES ('R-03'), ('R-04'), ('R-05')) t(tag)
           WHERE contains(note, tag) GROUP BY tag""",
        PAIRS_SQL,
    ),
)
def note_tags(spark, d):
    return K.note_tags(raters_v(spark, d), NOTES)


@query(
    "disagreements", "K10",
    with_sql("SELECT task_id, human, model FROM usable_v WHERE human <> model", PAIRS_SQL),
)
def disagreements(spark, d):
    return K.disagreements(pairs_v(spark, d)).select("task_id", "human", "model").orderBy("task_id")


def rescores_v(spark, d):
    return raters_v(spark, d).filter(F.col("task_id") % 3 == 0).select(
        "task_id", F.col("rating_2").alias("human")
    )


@query(
    "rescore_overlay", "K11 F3",
    with_sql(
        """SELECT human, rescored, count(*) AS n FROM (
             SELECT CASE WHEN s.r2 IN ('E0','E1','E2') THEN s.r2 ELSE p.human END AS human,
                    coalesce(s.r2 IN ('E0','E1','E2'), false) AS rescored
             FROM pairs_v p LEFT JOIN (SELECT * FROM clean_v WHERE task_id % 3 = 0) s USING (task_id))
           GROUP BY human, rescored""",
        PAIRS_SQL,
    ),
)
def rescore_overlay(spark, d):
    return K.rescore_overlay(pairs_v(spark, d), rescores_v(spark, d)).groupBy("human", "rescored").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "merged_rescores", "F3",
    with_sql(
        """SELECT coalesce(a.task_id, b.task_id) AS task_id,
                  coalesce(upper(trim(b.rating_3)), upper(trim(a.rating_2))) AS human
           FROM (SELECT * FROM raters_v WHERE task_id % 3 = 0) a
           FULL JOIN (SELECT * FROM raters_v WHERE task_id % 2 = 0) b ON a.task_id = b.task_id""",
        PAIRS_SQL,
    ),
)
def merged_rescores(spark, d):
    other = raters_v(spark, d).filter(F.col("task_id") % 2 == 0).select(
        "task_id", F.col("rating_3").alias("human")
    )
    return K.merge_rescores(rescores_v(spark, d), other)


W = {"E0": 0.0, "E1": 1.0, "E2": 0.5}
_H = "CASE human WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.5 ELSE 0.0 END"
_M = "CASE model WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.5 ELSE 0.0 END"


@query(
    "agreement_bounds", "K12",
    with_sql(
        f"""SELECT count(*) AS n_pairs, count(*) FILTER (human <> model) AS n_disagreements,
                   count(*) FILTER (least(human, model) = 'E0' AND greatest(human, model) = 'E1') AS flips_e0_e1,
                   count(*) FILTER (least(human, model) = 'E1' AND greatest(human, model) = 'E2') AS flips_e1_e2,
                   count(*) FILTER (least(human, model) = 'E0' AND greatest(human, model) = 'E2') AS flips_e0_e2,
                   round(avg({_M}), 6) AS beta_model, round(avg({_H}), 6) AS beta_human,
                   round(avg(least({_H}, {_M})), 6) AS bound_low, round(avg(greatest({_H}, {_M})), 6) AS bound_high,
                   round(avg({_H}) - avg({_M}), 6) AS substitution_delta FROM usable_v""",
        PAIRS_SQL,
    ),
)
def agreement_bounds(spark, d):
    out = K.agreement_bounds(K.confusion_counts(pairs_v(spark, d)))
    return out.select(
        "n_pairs", "n_disagreements", "flips_e0_e1", "flips_e1_e2", "flips_e0_e2",
        *[r(c) for c in ("beta_model", "beta_human", "bound_low", "bound_high", "substitution_delta")],
    )
