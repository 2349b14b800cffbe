"""The entry module, with and without the llm folder."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def said(folder):
    run = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120, check=True, env=os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"})
    return run.stdout.split()


def test_entry_without_llm(tmp_path):
    left = shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests"))
    many, ops, pipeline = said(left)
    assert int(many) > 60
    assert (ops, pipeline) == ("0", "False")


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "context", "n_sources"]
    assert df.count() > 0
