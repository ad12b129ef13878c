"""The entry module with and without the optional folder and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'exposure_by_region' in e.queries())"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_rest_works_without_the_optional_parts(tmp_path, left_out):
    skipped = shutil.ignore_patterns("__pycache__", *left_out)
    shutil.copytree(ROOT / "weftspan", tmp_path / "weftspan", ignore=skipped)
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(left_out):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    queries, sql, flagship = done.stdout.split()
    assert int(queries) >= int(sql) > 100 and flagship == "True"
