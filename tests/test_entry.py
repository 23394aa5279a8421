"""The driver's contract, with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_names_agree():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and all(map(callable, queries.values()))
    assert len(queries) > 120 and sum(n.startswith("ref_") for n in oracles) > 90


def test_nothing_outside_imports_the_llm_part():
    for path in REPO.joinpath("strandlog").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "strandlog.llm" not in path.read_text(), path


def test_works_without_the_llm_part(tmp_path):
    shutil.copytree(REPO / "strandlog", tmp_path / "strandlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_entry_runs(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["actor", "seq", "pos", "total"] and frame.count() > 0
