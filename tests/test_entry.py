"""The entry file with and without the parts that may be taken away."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(set(s) - set(q)), *q)"


def names(folder: Path) -> list[str]:
    env = os.environ | {"PYTHONPATH": str(folder)}
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out[1] == "0"  # every SQL has its query
    return out[2:]


@pytest.mark.parametrize("gone", [("corvane/llm",), ("corpus_pipeline.py",), ("corvane/llm", "corpus_pipeline.py")])
def test_queries_without_the_corpus_package(tmp_path, gone):
    shutil.copytree(ROOT / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    found = names(tmp_path)
    assert "time_1_bounded_sessions" in found and "pipeline" not in found
    assert ("op6_exact_dedup" in found) == ((ROOT / "corvane/llm").exists() and "corvane/llm" not in gone)


def test_nothing_else_imports_the_corpus_package():
    for path in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "corvane.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
