"""The entry works without the subpackage for training text, with and without the pipeline that needs it."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_training_text(tmp_path, pipeline):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "*.md", "*.txt", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = str(tmp_path / "copy")
    shutil.copytree(HERE, copy, ignore=skip)
    env = {**os.environ, "PYTHONPATH": copy, "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, check=True)
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-2000:]
