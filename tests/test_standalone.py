"""The library stands without the llm subpackage and the pipeline file."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline_left", [False, True])
def test_entry_without_llm(tmp_path, pipeline_left) -> None:
    if pipeline_left:
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    shutil.copytree(REPO / "bitloom", tmp_path / "bitloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm() -> None:
    for f in (REPO / "bitloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert "bitloom.llm" not in f.read_text()
