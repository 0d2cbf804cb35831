"""The library without the subpackage on training text."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_llm(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "*.md", "*.txt"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, check=True)
    assert int(out.stdout) >= 340
    # the pipeline's file alone isn't registered either
    shutil.copy(ROOT / "corpus_pipeline.py", copy) if (ROOT / "corpus_pipeline.py").exists() else None
    again = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, check=True)
    assert again.stdout == out.stdout
