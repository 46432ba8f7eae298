"""The library works where the training-data subpackage has been taken away."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(s) <= set(q); assert not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert 'pipeline' not in q; print(len(q))"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_queries_without_the_subpackage(tmp_path, pipeline_stays):
    shutil.copytree(os.path.join(ROOT, "wordloom"), tmp_path / "wordloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if pipeline_stays and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
