"""The entry module with and without the removable training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*sorted(q))"


@pytest.mark.parametrize("gone", [("fathomdex/llm",), ("fathomdex/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    from fathomdex import queries as engine

    top = tmp_path / "tree"
    shutil.copytree(ROOT, top, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md"))
    for name in gone:
        at = top / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=top, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split() == sorted(engine.QUERIES)
