"""The optional part of the entry points."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"], cwd=folder, env=os.environ | {"PYTHONPATH": folder}, capture_output=True, text=True, check=True)
    return run.stdout.split()


def test_the_rest_works_without_the_training_text_operators(tmp_path):
    shutil.copytree(f"{REPO}/seqgraph", tmp_path / "seqgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    plain = names(tmp_path)
    assert "bubble_align" in plain and not [n for n in plain if n.startswith("op") or n == "pipeline"]
    # What is left of a deleted folder, or one that can't be imported, is as good as none.
    os.mkdir(tmp_path / "seqgraph" / "llm")
    assert names(tmp_path) == plain
    (tmp_path / "seqgraph" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    assert names(tmp_path) == plain
