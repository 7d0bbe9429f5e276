"""The library stands without its optional text operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

from tests.conftest import REPO


def test_entry_loads_without_the_text_operators(tmp_path):
    for name in ("florascan", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(REPO, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'w1_series' in q and 'pipeline' not in q and set(s) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
