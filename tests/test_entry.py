"""The library without its training-data subpackage: entry, queries and SQL still load."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOAD = """
import __spark_entry__ as E
q, o = E.queries(), E.oracle_sql()
assert set(o) <= set(q) and len(q) > 80, len(q)
print(sorted(n for n in q if n.startswith("op") or n == "pipeline"))
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_loads_without_llm(tmp_path, pipeline):
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(
        ".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    run = subprocess.run([sys.executable, "-c", LOAD], cwd=copy, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
                         | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)
                                                          if p and os.path.realpath(p) != os.path.realpath(ROOT))})
    assert run.returncode == 0, run.stderr
    assert run.stdout.strip() == "[]"
