from pyspark.sql import functions as F

from weftspan.catalog.registry import load
from weftspan.plans.storage import scratch_path
from weftspan.sources import io


def test_leading_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "bridge.csv"
    path.write_text("Title\nSource\n\ncode,old\n15-1252.00,15-1132.00\n15-1253.00,\n")
    rows = io.read_text_csv(spark, str(path), skip=3).orderBy("code").collect()
    assert [tuple(r) for r in rows] == [("15-1252.00", "15-1132.00"), ("15-1253.00", None)]


def test_only_leading_lines_are_skipped(spark, tmp_path):
    text = 'Title\n\n"a,x",B\n1,2\nTitle\n"a,x",B\n'
    for name in ("one.csv", "two.csv"):
        (tmp_path / name).write_text(text)
    got = io.read_text_csv(spark, str(tmp_path), skip=2)
    assert got.columns == ["a,x", "B"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted([("1", "2"), ("Title", None), ("a,x", "B")] * 2)


def test_headcounts_fall_back_to_the_stored_aggregate(spark):
    stored = scratch_path(spark, "agg")
    io.write_csv(spark.createDataFrame([("251", 62, 1.5)], "group3 string, nic_div int, workers_m double"), stored)
    got = io.headcount_source(spark, scratch_path(spark, "none"), stored, lambda df: df)
    assert tuple(got.first()) == ("251", 62, 1.5)
    workers = scratch_path(spark, "workers")
    io.write_parquet(spark.range(3), workers)
    fresh = io.headcount_source(spark, workers, stored, lambda df: df.agg(F.count("*").alias("n")))
    assert fresh.first()["n"] == 3


def test_digests(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    row = io.file_digests(spark, str(tmp_path)).first()
    assert row["sha256"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_every_query_has_a_purpose():
    for name, entry in load().items():
        assert entry.covers, name
