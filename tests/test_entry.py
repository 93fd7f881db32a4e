"""The driver's entry without the folders for training text."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def entry_of(folder: Path) -> str:
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1') or n == 'pipeline' for n in e.queries()))"
    environment = {**os.environ, "PYTHONPATH": str(folder)}
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, env=environment, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return run.stdout


def test_entry_without_the_training_text(tmp_path):
    """With `llm` gone, and with or without the pipeline beside it, the other queries stay."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    with_pipeline = entry_of(copy)
    assert with_pipeline.split()[2] == "False"
    bare = tmp_path / "bare"
    shutil.copytree(copy, bare, ignore=shutil.ignore_patterns("corpus_pipeline.py"))
    assert entry_of(bare) == with_pipeline


def test_entry_raises_when_a_part_is_broken(tmp_path):
    """Only the absence of the whole folder is passed over."""
    copy = tmp_path / "broken"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    (copy / "plantwatch" / "llm").mkdir()
    (copy / "plantwatch" / "llm" / "queries.py").write_text("import a_module_that_is_missing\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert run.returncode and "a_module_that_is_missing" in run.stderr
