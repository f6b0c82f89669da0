"""The library without its text-preparation package: the driver deletes both folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert not (copy / "postlake" / "llm").exists() and not (copy / "corpus_pipeline.py").exists()
    code = ("import __spark_entry__ as e; q = e.queries(); "
            "assert 'ge6_build_examples' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); "
            "print(len(q))")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 100
