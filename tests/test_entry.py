import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["alpha10", "k", "gold_rate", "nf_rate", "n"] and df.count() == 12


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.parquet"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
