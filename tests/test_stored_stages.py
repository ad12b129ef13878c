"""Stages on disk: buckets that stay in place, the keyed store, observed reports, headers per file."""

from pathlib import Path

from pyspark.sql import functions as F

from weftspan.operators import contracts as G
from weftspan.operators import fixed_effects as Q
from weftspan.operators import labels as C
from weftspan.plans.ranking import ordered_sequence
from weftspan.plans.storage import scratch_path
from weftspan.sources import io


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_are_not_moved_again(spark):
    tables = []
    for name, rows in (("left", 500), ("right", 800)):
        path = scratch_path(spark, name)
        frame = spark.range(rows).select((F.col("id") % 97).alias("k"), F.col("id").alias(name))
        tables.append(io.write_bucketed(frame, f"t_{path.rsplit('-', 1)[-1]}", path, "k", 4))
    joined = tables[0].join(tables[1].hint("merge"), "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
    assert joined.agg(F.sum("n")).first()[0] == sum(len(range(k, 500, 97)) * len(range(k, 800, 97)) for k in range(97))


def names(path):
    return {p.relative_to(path).as_posix() for p in Path(path).rglob("part-*")}


def test_upsert_rewrites_touched_ranges_alone(spark):
    kind = "key string, created_at string, response string"
    path = scratch_path(spark, "store")
    first = [(f"k{i}", "2024-01-01", "old") for i in range(200)]
    C.upsert_store(spark, path, spark.createDataFrame(first, kind), ranges=8)
    before = names(path)
    new = spark.createDataFrame([("k3", "2024-01-02", "new"), ("k4", "2023-01-01", "late"), ("other", "2024-01-01", "new")], kind)
    got = {r["key"]: r["response"] for r in C.upsert_store(spark, path, new, ranges=8).collect()}
    assert len(got) == 201 and got["k3"] == "new" and got["k4"] == "old" and got["other"] == "new"
    touched = {f"range={r[0]}" for r in new.select(C.store_range("key", 8)).collect()}
    assert {n for n in before if n.split("/")[0] not in touched} == {n for n in names(path) if n.split("/")[0] not in touched}
    assert not {n for n in before if n.split("/")[0] in touched} & names(path)


def test_observed_report_is_that_of_the_written_rows(spark):
    path = scratch_path(spark, "observed")
    report = io.write_observed(spark.range(100).filter("id % 3 = 0"), path, [F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")])
    assert report == {"n": 34, "s": sum(range(0, 100, 3))} and spark.read.parquet(path).count() == 34


def test_each_file_has_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title\n"x,1",y\n1,"2,5"\n')
    (tmp_path / "b.csv").write_text('Title\ny, z\n3,4\nTitle\n')
    (tmp_path / "c.csv").write_text("Title\n")
    got = io.read_text_csv(spark, str(tmp_path), skip=1)
    assert sorted(got.columns) == ["x,1", "y", "z"]
    rows = {tuple(r[c] for c in sorted(got.columns)) for r in got.collect()}
    assert rows == {("1", "2,5", None), (None, "3", "4"), (None, "Title", None)}


def test_uniqueness_of_several_columns(spark):
    contract = G.Contract("t", (G.Field("a", "bigint", unique=True), G.Field("b", "string", unique=True, nullable=True), G.Field("c", "bigint", unique=True)))
    rows = [(1, "x", 1), (2, "x", 2), (2, None, 3), (2, None, 4), (5, "y", 5)]
    got = {(r["rule"], r["column"], r["n"], r["sample"]) for r in G.violations(spark.createDataFrame(rows, "a long, b string, c long"), contract).collect()}
    assert got == {("unique", "a", 3, "2"), ("unique", "b", 2, "x")}


def test_rows_are_numbered_in_order(spark):
    frame = spark.range(5_000).select((F.hash("id") % 50).alias("a"), "id").repartition(7)
    got = ordered_sequence(frame, [F.desc("a"), F.asc("id")], "n").collect()
    want = sorted(((r["a"], r["id"]) for r in got), key=lambda t: (-t[0], t[1]))
    assert [(r["a"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in got) == list(range(1, 5_001))


def test_samples_fitted_together_equal_samples_apart(spark):
    """Unbalanced panels, against dense dummies."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for spec, share in (("one", 0.7), ("two", 0.4)):
        for i in range(12):
            for t in range(15):
                if rng.random() < share:
                    x = float(rng.normal() + i * t / 50)
                    rows.append((spec, f"i{i}", f"t{t:02d}", x, float(2 * x + i - t + rng.normal())))
    frame = spark.createDataFrame(rows, "spec string, i string, t string, x double, y double")
    got = {r["spec"]: r for r in Q.within_ols(frame, "y", ["x"], ["i", "t"], "i", "spec").collect()}
    for spec in ("one", "two"):
        own = [r for r in rows if r[0] == spec]
        units, times = sorted({r[1] for r in own}), sorted({r[2] for r in own})
        dummies = np.array([[r[3], *[r[1] == u for u in units], *[r[2] == t for t in times[1:]]] for r in own], float)
        slope = np.linalg.lstsq(dummies, np.array([r[4] for r in own]), rcond=None)[0][0]
        assert abs(got[spec]["estimate"] - slope) < 1e-8 and got[spec]["n_obs"] == len(own)
        alone = Q.within_ols(frame.filter(F.col("spec") == spec), "y", ["x"], ["i", "t"], "i").first()
        assert abs(alone["std_error"] - got[spec]["std_error"]) < 1e-9 and alone["p_value"] == got[spec]["p_value"] or abs(alone["p_value"] - got[spec]["p_value"]) < 1e-9
