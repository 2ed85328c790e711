"""The queries are registered, and the rest works without this subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from larkspan.llm.queries import ORACLES, QUERIES

REPO = Path(__file__).resolve().parents[2]


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert ORACLES.keys() <= QUERIES.keys()
    assert {*QUERIES, "pipeline"} <= __spark_entry__.queries().keys()


def without_it(tmp_path):
    """A copy of the repository without this subpackage, its tests and the pipeline."""
    left_out = shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache", "corpus_pipeline.py")
    shutil.copytree(REPO, tmp_path / "rest", ignore=left_out)
    return tmp_path / "rest"


def ran(folder, *command):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTEST_CURRENT_TEST")}
    return subprocess.run([sys.executable, *command], cwd=folder, env=env, capture_output=True, text=True)


def test_the_rest_imports_without_it(tmp_path):
    out = ran(without_it(tmp_path), "-c", "import __spark_entry__ as e; print(*e.queries())")
    assert out.returncode == 0, out.stderr
    assert "op1_" not in out.stdout and "plumbing" in out.stdout and "larkspan.llm" not in out.stdout


def test_the_rest_passes_its_tests_without_it(tmp_path):
    folder = without_it(tmp_path)
    out = ran(folder, "-m", "pytest", "tests", "-x", "-q", "-p", "no:cacheprovider")
    assert out.returncode == 0, out.stdout[-3000:]


def test_a_missing_library_leaves_the_other_queries(tmp_path):
    """Where a library of these operators is absent, the rest is registered and the reason told."""
    code = (
        "import sys; sys.modules['ahocorasick'] = None\n"
        "import __spark_entry__ as e; print(*e.queries())"
    )
    out = ran(REPO, "-c", code)
    assert out.returncode == 0 and out.stdout.split() == ["plumbing_local_supplier_revenue"]
    assert "ahocorasick" in out.stderr


def test_nothing_else_imports_it():
    for path in (REPO / "larkspan").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
