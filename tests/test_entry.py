"""The core without the optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import importlib.abc, sys
class Block(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if any((name + ".").startswith(b + ".") for b in {names!r}):
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
from trialspark.queries import ORACLE, QUERIES
assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
print(sorted(n for n in e.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"))
"""


def run(names):
    return subprocess.run([sys.executable, "-c", BLOCKED.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("names", [["trialspark.llm"], ["trialspark.llm", "corpus_pipeline"], ["trialspark.llm.queries", "corpus_pipeline"]])
def test_core_works_without_optional_parts(names):
    done = run(names)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[]"


def test_other_missing_modules_are_errors():
    if not os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        pytest.skip("the optional parts are absent")
    done = run(["public_tokenizers"])
    assert done.returncode != 0 and "public_tokenizers" in done.stderr
