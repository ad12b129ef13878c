"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest
from compare import compare, duck

from weftspan.catalog.registry import load

FOLDER = "/root/testdata/sf0.001"
#: A mean lies on a rounding tie at the smallest size, where engines differ.
LARGER = {"vintage_drift": "/root/testdata/sf0.01"}
NAMES = sorted(name for name, entry in load().items() if entry.sql)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    entry = load()[name]
    folder = LARGER.get(name, FOLDER)
    assert compare(spark, duck(folder), name, entry.run, entry.sql, folder).startswith("ok")
