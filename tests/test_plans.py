"""Ranking, carry-forward and exact medians, also under skew."""

import random
import statistics

from pyspark.sql import functions as F

from weftspan.functions.numeric import group_median, zero_fill
from weftspan.plans.ranking import carry_forward, hash_sequence, top_per_group
from weftspan.plans.sizing import small_side


def test_top_per_group_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.random()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, i int, v double")
    got = top_per_group(frame, ["k"], [F.desc("v"), F.asc("i")], 5, "place").collect()
    want = {}
    for k, i, v in sorted(rows, key=lambda r: (-r[2], r[1])):
        want.setdefault(k, [])
        if len(want[k]) < 5:
            want[k].append(i)
    for k, ids in want.items():
        assert [r["i"] for r in sorted(got, key=lambda r: r["place"]) if r["k"] == k] == ids


def test_hash_sequence_orders_everything(spark):
    frame = spark.range(5000).withColumn("d", F.md5(F.col("id").cast("string")))
    rows = hash_sequence(frame, F.col("d"), "seq").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 5001))
    assert [r["d"] for r in rows] == sorted(r["d"] for r in rows)


def test_carry_forward_over_pages(spark):
    rng = random.Random(2)
    rows, want, before = [], {}, {}
    state, last = {"a": None, "b": None}, None
    for page in range(8):
        for line in range(6):
            v = f"s{page}.{line}" if rng.random() < 0.15 else None
            rows.append(("f", page, line, v))
            before[(page, line)] = state["a"]
            state["a"] = v or state["a"]
            want[(page, line)] = state["a"]
    frame = spark.createDataFrame(rows, "f string, page int, line int, s string")
    got = carry_forward(frame, ["f"], "page", ["line"], ["s"]).collect()
    assert {(r["page"], r["line"]): r["s"] for r in got} == want
    got = carry_forward(frame, ["f"], "page", ["line"], ["s"], inclusive=False).collect()
    assert {(r["page"], r["line"]): r["s"] for r in got} == before


def test_carry_forward_over_blocks_of_pages(spark):
    """One source of very many pages, states far apart."""
    pages = 200_000
    frame = spark.range(pages).select(
        F.lit("f").alias("f"), (F.col("id") * 40_000).alias("page"), F.lit(0).alias("line"),
        F.when(F.col("id") % 60_000 == 7, F.col("id")).alias("s"),
    )
    got = carry_forward(frame, ["f"], "page", ["line"], ["s"])
    want = F.when(F.col("n") >= 7, (F.floor((F.col("n") - 7) / 60_000) * 60_000 + 7))
    assert got.withColumn("n", (F.col("page") / 40_000).cast("long")).filter(~F.col("s").eqNullSafe(want)).count() == 0
    assert got.count() == pages


def test_median_is_exact(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(1000))) for _ in range(4001)]
    rows += [("even", 1.0), ("even", 2.0), ("even", 3.0), ("even", 10.0), ("one", 7.0), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["m"] for r in group_median(frame, ["g"], "v", "m").collect()}
    hot = statistics.median(v for g, v in rows if g == "hot")
    assert got == {"hot": hot, "even": 2.5, "one": 7.0}


def test_small_side_checks_size(spark):
    plan = small_side(spark.range(100), 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower()
    plan = small_side(spark.range(5), 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan.lower()


def test_zero_fill_keeps_long_text(spark):
    row = spark.range(1).select(zero_fill(F.lit("7"), 3).alias("a"), zero_fill(F.lit("12345"), 3).alias("b")).first()
    assert (row["a"], row["b"]) == ("007", "12345")
