"""The repository without the training-data folders and their pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import warnings
warnings.simplefilter("ignore")
import __spark_entry__ as contract
names = set(contract.queries())
assert len(names) > 100 and not contract.LLM_QUERIES, names
assert set(contract.oracle_sql()) <= names
"""


def test_core_queries_without_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert not (copy / "wearline" / "llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
