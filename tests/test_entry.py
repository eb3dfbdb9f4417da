import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 40


def test_the_rest_works_without_the_removable_part(tmp_path):
    """A copy of the repository without the folders and the pipeline."""
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", "tests", ".git", "__pycache__", "*.md", "*.json")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kv_current' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "repo")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)


def test_other_missing_modules_are_errors(monkeypatch):
    def fail(name):
        raise ModuleNotFoundError("no wheel", name="some_wheel")

    monkeypatch.setattr(entry.importlib, "import_module", fail)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_nothing_else_imports_the_removable_part():
    for p in (ROOT / "cairn").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "cairn").parts[:1]:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
