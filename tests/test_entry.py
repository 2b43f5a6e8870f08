"""What the driver calls, also after the training-data operators were taken out."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(x.startswith('op') for x in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [["quire/llm", "tests/llm", "corpus_pipeline.py"], ["quire/llm", "tests/llm"], ["corpus_pipeline.py"], []])
def test_entry_without_parts(tmp_path, gone):
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    for name in gone:
        path = tmp_path / "copy" / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, operators, pipeline = done.stdout.split()
    llm = (tmp_path / "copy/quire/llm").is_dir()
    assert int(n) >= 43 and operators == str(llm) and pipeline == str(llm and (tmp_path / "copy/corpus_pipeline.py").exists())
