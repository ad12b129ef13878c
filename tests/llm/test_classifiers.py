"""Language profiles and the toxicity learner: cases, and accuracy on held-out rows."""

import numpy as np
import pytest
from cases import documents, held_out
from pyspark.sql import functions as F

from weftspan.llm import language, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_language_cases(spark):
    docs = documents(spark, clash=True)
    profiles = language.learn(docs)
    rows = {r["doc_id"]: r for r in language.predict(docs, profiles, ["doc_id", "held_out", "keys"]).collect()}
    assert len(rows) == 14 and profiles.names == ["de", "en"]
    for doc_id in (4, 5, 6):
        assert (rows[doc_id]["lang_pred"], rows[doc_id]["score"]) == ("und", 0.0)
    assert rows[7]["lang_pred"] in profiles.names and rows[1]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[1]["keys"] == "keep1"
    none = language.learn(documents(spark, []))
    assert none.names == [] and language.predict(docs, none, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert language.predict(documents(spark, []), profiles, ["doc_id"]).count() == 0


def test_bundle_is_the_sum_of_bound_rotations():
    grams = language.Grams(256, 3)
    codes = language.letter_codes(" ab1é ")
    assert codes.tolist() == [0, ord("a"), ord("b"), 0, ord("é"), 0]
    total = np.zeros(256)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        total += grams.letter(int(a)).astype(int) * np.roll(grams.letter(int(b)).astype(int), 1) * np.roll(grams.letter(int(c)).astype(int), 2)
    assert np.array_equal(grams.bundle("ab1é"), total)


def test_bounded_rows_depend_on_ids_alone(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    some = language.bounded(rows, F.col("doc_id"), 2_000)
    assert 1_700 < some.count() < 2_300
    assert language.bounded(rows, F.col("doc_id"), 20_000).count() == 20_000


def test_language_accuracy(spark):
    got = queries.op4_language(spark, FOLDER).join(queries.table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_toxicity_cases(spark):
    docs = documents(spark, clash=True)
    constant = toxicity.learn(docs.select("doc_id", "text").withColumn("label", F.lit(None).cast("int")))
    assert len(constant.buckets) == 0
    assert {r["score"] for r in toxicity.score(docs, constant, ["doc_id", "keys"]).collect()} == {0.5}
    rows = [(i, ("foul " if i % 3 == 0 else "kind ") + f"a{i % 7} b{i % 5}", "en", "s", 1) for i in range(600)]
    train = documents(spark, rows).select("doc_id", "text", (F.col("doc_id") % 3 == 0).cast("int").alias("label"))
    model = toxicity.learn(train)
    assert len(model.buckets) < 50
    kept = toxicity.without_toxic(documents(spark, [*rows[:9], (None, None, None, None, None), (99, "", "en", "s", 0), (98, "so foul", "en", "s", 0)]), model)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 4, 5, 7, 8, 99)] + [(True, 0)]
    assert toxicity.without_toxic(documents(spark, [], clash=True), model).count() == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_ftrl_weights_have_the_closed_form():
    ftrl = toxicity.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    at = np.array([0, 2])
    ftrl.learn(at, 1.0)
    assert np.allclose(ftrl.z[at], -0.5) and np.allclose(ftrl.n[at], 0.25)
    assert np.allclose(ftrl.weights(at), 0.4 / ((1 + 0.5) / 0.5 + 0.2)) and not ftrl.weights(np.array([1])).any()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_toxicity_on_held_out_rows(spark, folder):
    labels = queries.table(spark, folder, "labels").select("doc_id", "toxic")
    got = queries.op6_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    score, toxic = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got]) == 1
    order = np.argsort(np.argsort(score)) + 1
    area = (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.95 and np.mean((score >= 0.5) == toxic) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held_out(r["doc_id"]) for r in got)
