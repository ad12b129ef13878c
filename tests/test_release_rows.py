"""Release tables written by hand."""

import pytest

from weftspan.operators import panel as P
from weftspan.operators import release_rows as R

SCHEMA = "release string, file string, page int, table_no int, row_no int, cells array<string>"


def table(spark, release, pages):
    rows = [
        (release, "f", page, 1, i, cells) for page, block in pages.items() for i, cells in enumerate(block)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_flow_block_continues_on_the_next_page(spark):
    got = R.parse_release_rows(table(spark, "epfo_2025-09", {
        7: [["April 2025", "", "", "", ""], ["Age Slab", "a", "b", "c", "d"], ["", "(a)", "(b)", "(c)", "(d)"]],
        8: [["18-21", "2,97,523", "1,71,826", "1,67,982", "2,93,679"], ["Total", "1", "1", "1", "1"],
            ["22-25", "5", "1", "1", "6"], ["26-28", "n/a", "1", "1", "1"]],
        9: [["2019-20", "", "", "", ""], ["Age Slab", "a", "b", "c", "d"], ["", "(a)", "(b)", "(c)", "(d)"],
            ["18-21", "9", "9", "9", "9"]],
    }))
    values = {(r["age_band"], r["measure"]): r["value"] for r in got.panel.collect()}
    assert values[("18-21", "net_payroll")] == 293679
    assert values[("22-25", "net_payroll")] == 6
    assert len(values) == 8
    details = sorted(r["detail"].split(":")[0] for r in got.issues.collect())
    assert details == ["identity a-b+c!=d", "unparseable cells"]


def gender_row(label, *three):
    cells = [label]
    for male in three:
        cells += [str(male), "1", "-", "0", str(male + 1)]
    return cells


HEAD = ["Age", "New EPF subscribers", "", "", "", "", "ceased", "", "", "", "", "rejoined", "", "", "", ""]
GENDERS = ["Male", "Female", "Others", "Not Available", "Total"] * 3


def test_gender_block_with_garbled_header_and_label(spark):
    sub = ["", "Male", "Fem#le", *GENDERS[2:]]
    bands = ["Less than 18", "B - 18-21", "22-25", "26-28", "~~", "More than 35"]
    block = [["May 2019", *[""] * 15], HEAD, sub, *[gender_row(b, 3, 4, 5) for b in bands]]
    got = R.parse_release_rows(table(spark, "mospi_2019-12", {2: block}), national_from_gender=True)
    panel = got.panel.collect()
    assert len(panel) == 6 * 3 * 5
    assert {r["age_band"] for r in panel} == {"<18", "18-21", "22-25", "26-28", "29-35", ">35"}
    assert sum(r["value"] for r in panel if r["gender"] is None) == 6 * (4 + 5 + 6)
    notes = " ".join(r["detail"] for r in got.issues.collect())
    assert "positional fallback" in notes and "only missing band" in notes


def test_bad_rows_are_dropped_and_logged(spark):
    wrong = gender_row("18-21", 3, 4, 5)
    wrong[5] = "99"
    block = [["May 2019", *[""] * 15], HEAD, ["", *GENDERS], wrong, gender_row("~~", 1, 1, 1)]
    got = R.parse_release_rows(table(spark, "mospi_2019-12", {2: block}))
    assert got.panel.count() == 0
    assert sorted(r["detail"][:7] for r in got.issues.collect()) == ["dropped", "row-sum"]


def test_wide_tables_and_header_fix(spark):
    got = R.parse_release_rows(table(spark, "epfo_2021-05", {
        3: [["Age Bucket: Less than 18", "", "", ""], ["State", "2019-20", "Apr-19", "May-20"],
            ["TAMIL NADU", "7", "-5", "1,772"], ["SUB TOTAL", "1", "1", "1"], ["GOA", "1", "x", "2"]],
        4: [["Month/Age", "<18", "18-21", "Total"], ["May-20", "1,774", "3", "9"]],
    }))
    values = {(r["state"], r["data_month"]): r["value"] for r in got.panel.collect()}
    assert values == {("TAMIL NADU", "2020-04"): -5, ("TAMIL NADU", "2020-05"): 1772, ("GOA", "2020-05"): 2}
    assert sorted((r["age_band"], r["value"]) for r in got.grid.collect()) == [("18-21", 3), ("<18", 1774)]
    assert got.issues.count() == 2


def test_stitching_and_panel_checks(spark):
    panel = spark.createDataFrame(
        [("2021-05", "epfo_2021-05", "ceased", "<18", None, None, None, 1)],
        "data_month string, source_release string, measure string, age_band string, gender string, industry string, state string, value bigint",
    )
    with pytest.raises(ValueError):
        R.stitch(panel, R.release_map(spark))
    with pytest.raises(ValueError):
        P.check_panel(panel.unionByName(panel))
    assert P.check_panel(panel) is panel
