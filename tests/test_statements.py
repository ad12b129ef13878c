"""Entry parsing on hand lines."""

from weftspan.operators import statements as B

SCHEMA = "file string, page int, line_no int, text string"
LONG = "prepares reports and keeps accounts of daily work. Checks bills; Signs letters."


def entries(spark, texts):
    rows = [("vol", i // 3, i, t) for i, t in enumerate(texts)]
    lines = B.drop_furniture(spark.createDataFrame(rows, SCHEMA))
    return {r["nco_code"]: r for r in B.split_entries(B.segment_by_code(lines)).collect()}


def test_segments_titles_and_descriptions(spark):
    got = entries(spark, [
        "VOLUME II A", "preamble", "1324.1100", "Traffic Officer, Air Service/Traffic", "Controller", "12",
        "Traffic Officer, Air Service supervises move -", "ment of aircraft and " + LONG,
        "ISCO 08 Unit Group Details:", "Code 1324 Title", "text 1325.0100 Butler Butlers",
        "Butler " + LONG, "Qualification Pack Details: none", "1326.0100", "Clerk records " + "entries in the ledger",
        "every day without fail and keeps the ledger.", "1327.0100", "Too short",
    ])
    assert set(got) == {"1324.1100", "1325.0100", "1326.0100"}
    first = got["1324.1100"]
    assert first["occupation_title"] == "Traffic Officer, Air Service/Traffic Controller"
    assert first["description"].startswith("Traffic Officer, Air Service supervises move-ment of aircraft")
    assert "ISCO" not in first["description"]
    assert got["1325.0100"]["occupation_title"] == "Butlers"
    assert got["1326.0100"]["occupation_title"] == "Clerk"
    assert got["1326.0100"]["description"].startswith("records entries in the ledger")
    assert (first["family"], first["group3"], first["division"]) == ("1324", "132", "1")


def test_split_verb_in_two_tokens(spark):
    got = entries(spark, ["1100.0100", "Helper assi sts the cook in the", "kitchen of a large hotel all day long."])
    assert got["1100.0100"]["occupation_title"] == "Helper"
    assert got["1100.0100"]["description"].startswith("assists the cook in the kitchen")


def test_statements_lose_alias_and_are_numbered(spark):
    frame = spark.createDataFrame(
        [("1100.0100", "Officer; Traffic Officer", "Traffic Officer, guides traffic at ports. Short. Writes daily reports; Keeps logs of flights;")],
        "nco_code string, occupation_title string, description string",
    )
    got = [(r["task_id"], r["task_text"]) for r in B.split_statements(frame).orderBy("task_no").collect()]
    assert got == [
        ("1100.0100-t01", "Guides traffic at ports."),
        ("1100.0100-t02", "Writes daily reports."),
        ("1100.0100-t03", "Keeps logs of flights."),
    ]


def test_one_per_code_by_text_and_by_length(spark):
    frame = spark.createDataFrame(
        [("c", "zz", "s", "t"), ("c", "a much longer text", "s", "t")],
        "nco_code string, description string, source string, occupation_title string",
    )
    assert B.one_per_code(frame).first()["description"] == "zz"
    assert B.one_per_code(frame, longest=True).first()["description"] == "a much longer text"
