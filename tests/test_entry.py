"""The entry module in copies of the library without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left_out", [("cliptide/llm",), ("cliptide/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_imports_without(tmp_path, left_out):
    kept = shutil.ignore_patterns(".git", "__pycache__", "tests", *[os.path.basename(p) for p in left_out])
    shutil.copytree(ROOT, tmp_path / "copy", ignore=kept)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, corpus, pipeline, checked = done.stdout.split()[-4:]
    assert int(n) > 100 and (pipeline, checked) == ("False", "True")
    # Without the package there is no corpus query; without the pipeline file the others stay, where the package is there.
    there = "cliptide/llm" not in left_out and os.path.isdir(os.path.join(ROOT, "cliptide", "llm"))
    assert (int(corpus) > 0) == there
