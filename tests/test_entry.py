"""The driver's entry works with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 150; print(sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"


def names(folder) -> str:
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return done.stdout.strip()


def test_entry_without_corpus_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(HERE, tmp_path / "all", ignore=skip)
    assert names(tmp_path / "all") == "[]"
    os.remove(tmp_path / "all" / "corpus_pipeline.py")
    assert names(tmp_path / "all") == "[]"
