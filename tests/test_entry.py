"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(set(o) - set(q)), callable(q['nonoverlap_groups']), 'whole_alignment' in o)"


@pytest.mark.parametrize("left", ["nothing", "compiled files", "a broken import"])
def test_entry_without_the_subpackage(tmp_path, left):
    shutil.copytree(REPO / "kmerloom", tmp_path / "kmerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        (tmp_path / "kmerloom/llm/__pycache__").mkdir(parents=True)
    if left == "a broken import":
        (tmp_path / "kmerloom/llm/__init__.py").write_text("")
        (tmp_path / "kmerloom/llm/queries.py").write_text("import a_library_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split() == ["29", "[]", "True", "True"]
