"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"


def names(folder):
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",), ("quillmine/llm",), ("quillmine/llm", "corpus_pipeline.py")])
def test_queries_survive_deletion(tmp_path, gone):
    from quillmine.plans import catalog

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "spark-warehouse"))
    for name in gone:
        at = tmp_path / "repo" / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    got = names(tmp_path / "repo")
    assert set(catalog.QUERIES) <= got
    there = os.path.isdir(tmp_path / "repo/quillmine/llm")
    assert any(n.startswith("op1_") for n in got) == there
    assert ("pipeline" in got) == (there and os.path.exists(tmp_path / "repo/corpus_pipeline.py"))


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
