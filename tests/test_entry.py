"""The registry without the optional training-data folder, and with a fault inside it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k[:2] == 'op' and k[2:3].isdigit() or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


def run(folder, code=COUNT):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


@pytest.fixture
def copy(tmp_path):
    """The repository without the optional folders; the pipeline's module stays."""
    shutil.copytree(ROOT / "eventcal", tmp_path / "eventcal", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    return tmp_path


def test_without_the_folder(copy):
    got = run(copy)
    assert got.returncode == 0, got.stderr
    from eventcal.plans import registry

    assert got.stdout.split() == [str(len(registry.queries())), "0", "True"]


def test_without_folder_and_pipeline(copy):
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run(copy).returncode == 0


def test_a_fault_inside_is_raised(copy):
    (copy / "eventcal/llm").mkdir()
    (copy / "eventcal/llm/__init__.py").write_text("")
    (copy / "eventcal/llm/queries.py").write_text("import no_such_module_at_all\n")
    got = run(copy)
    assert got.returncode != 0 and "no_such_module_at_all" in got.stderr
