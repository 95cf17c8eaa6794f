from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(len([n for n in e.queries() if n.startswith('op') and n[2].isdigit()]), 'pipeline' in e.queries(), len(e.queries()) > 50, set(e.oracle_sql()) <= set(e.queries()))"


def names(at):
    return subprocess.run([sys.executable, "-c", NAMES], cwd=at, capture_output=True, text=True, check=True).stdout.split()


def test_entry_with_and_without_the_text_operators(tmp_path):
    bare = tmp_path / "bare"
    shutil.copytree(REPO / "quarry", bare / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", bare)
    assert names(bare) == ["0", "False", "True", "True"]
    if (REPO / "quarry/llm").exists():
        assert names(REPO) == ["10", "True", "True", "True"]
        broken = tmp_path / "broken"
        shutil.copytree(REPO / "quarry", broken / "quarry", ignore=shutil.ignore_patterns("__pycache__"))
        shutil.copy(REPO / "__spark_entry__.py", broken)
        shutil.copy(REPO / "corpus_pipeline.py", broken)
        (broken / "quarry/llm/common.py").write_text("import no_such_module\n")
        run = subprocess.run([sys.executable, "-c", NAMES], cwd=broken, capture_output=True, text=True)
        assert "no_such_module" in run.stderr  # a fault in the operators isn't taken for their absence


def test_nothing_else_imports_the_text_operators():
    others = [p for p in (REPO / "quarry").rglob("*.py") if "llm" not in p.relative_to(REPO).parts]
    assert others and not any("quarry.llm" in p.read_text() for p in others)
