import pytest

from weftspan.operators import contracts as G

GOOD = ("7412.0100", "741", "Electrician", "7412.0100-t01", "Installs and repairs wiring", "nco_vol2b")
SCHEMA = "nco_code string, group3 string, occupation_title string, task_id string, task_text string, source string"


def test_valid_row_passes(spark):
    frame = spark.createDataFrame([GOOD], SCHEMA)
    assert G.enforce(frame, G.TASK_STATEMENTS) is frame


def test_all_failures_are_reported(spark):
    bad = ("74X2", "741", None, "7412.0100-t01", "short", "elsewhere")
    with pytest.raises(G.ContractError) as error:
        G.enforce(spark.createDataFrame([GOOD, bad], SCHEMA), G.TASK_STATEMENTS)
    for part in ("nco_code: regex", "occupation_title: not_null", "task_id: unique", "task_text: min_length", "source: isin"):
        assert part in str(error.value)


def test_label_and_range_rules(spark):
    score = spark.createDataFrame(
        [("t", "0.1", "m", "E3", 0, 2, 1, False, "2026-07-17")],
        "task_id string, rubric_version string, model string, score string, votes_e0 bigint, votes_e1 bigint, votes_e2 bigint, tie_escalated boolean, scored_at string",
    )
    assert [(r["rule"], r["column"]) for r in G.violations(score, G.TASK_SCORES).collect()] == [("isin", "score")]
    index = spark.createDataFrame(
        [("7412", "Electrician", 12, "E1", 0.25, 0.4, 1.2, "0.1", True)],
        "nco_code string, occupation_title string, n_tasks bigint, variant string, alpha double, beta double, zeta double, rubric_version string, preliminary boolean",
    )
    assert [(r["rule"], r["column"]) for r in G.violations(index, G.OCCUPATION_INDEX).collect()] == [("le", "zeta")]


def test_gates(spark):
    one = spark.createDataFrame([(0.5, None)], "a double, b double")
    assert G.gate(one, "a", minimum=0.7).first()["gate"] == "FAIL"
    assert G.gate(one, "a", maximum=0.7).first()["gate"] == "PASS"
    assert G.gate(one, "b", minimum=0.7).first()["gate"] == "not computable"
    with pytest.raises(G.GateError):
        G.stop_unless(one, "a", minimum=0.7)
    assert G.stop_unless(one, "a", minimum=0.5) is one


def test_golden(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "i int, t string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, t string")
    assert G.golden_diff(a, a).count() == 0
    assert sorted((r["i"], r["side"]) for r in G.golden_diff(a, b).collect()) == [(1, "new"), (2, "golden")]
    with pytest.raises(G.ContractError):
        G.golden_diff(a, b.select("i"))
