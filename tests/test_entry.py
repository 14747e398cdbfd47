"""The entry module with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def counts(root):
    done = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return list(map(int, done.stdout.split()[-3:]))


@pytest.mark.parametrize("left_out", [("gleaner/llm", "tests/llm"), ("gleaner/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_imports_without_the_training_data_part(tmp_path, left_out):
    def skip(folder, names):
        at = os.path.relpath(folder, ROOT)
        return [n for n in names if os.path.normpath(os.path.join(at, n)) in left_out or n in (".git", "__pycache__")]

    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    queries, oracles, of_the_part = counts(tmp_path / "repo")
    if "gleaner/llm" in left_out:
        assert of_the_part == 0
    assert queries - of_the_part > 85 and oracles > 80


def test_no_other_module_imports_the_training_data_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "gleaner")):
        for name in names:
            if name.endswith(".py") and not folder.endswith(os.path.join("gleaner", "llm")):
                with open(os.path.join(folder, name)) as f:
                    assert "gleaner.llm" not in f.read(), name
