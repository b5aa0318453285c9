"""The driver's entry points, with and without the optional corpus part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_flagship_has_rows(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables here")
    df = entry.entry(spark)
    assert df.columns == ["listing", "status", "misses", "first_seen", "last_seen", "last_verified"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_it_works_without_the_corpus_part(tmp_path):
    shutil.copytree(REPO / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names == set(e.oracle_sql()) and len(names) > 25; print(len(names))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_part():
    for file in (REPO / "tidemark").rglob("*.py"):
        if "llm" not in file.parts:
            assert "llm" not in file.read_text()
