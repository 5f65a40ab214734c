"""The entry point with and without the subpackage on training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = "import __spark_entry__ as e, bench, check; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [("tidemark/llm",), ("tidemark/llm", "corpus_pipeline.py")])
def test_the_rest_imports_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", "tests", *(Path(g).name for g in gone))
    shutil.copytree(ROOT, copy, ignore=skip)
    made = subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, capture_output=True, text=True, timeout=120)
    assert made.returncode == 0, made.stderr
    names, oracles = (set(line.split()) for line in made.stdout.splitlines())
    assert "pit_multi_view" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
    assert oracles <= names


def test_an_error_inside_the_subpackage_is_an_error(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "llm"))
    (copy / "tidemark" / "llm").mkdir()
    (copy / "tidemark" / "llm" / "__init__.py").write_text("")
    (copy / "tidemark" / "llm" / "queries.py").write_text("import no_such_module\n")
    made = subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, capture_output=True, text=True, timeout=120)
    assert made.returncode != 0 and "no_such_module" in made.stderr
