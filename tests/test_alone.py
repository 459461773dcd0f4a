"""The rest of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_llm_folders(tmp_path, pipeline):
    left_out = shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    number, any_llm = done.stdout.split()
    assert int(number) > 50 and any_llm == "False"


def test_other_missing_modules_are_errors(tmp_path, monkeypatch):
    import __spark_entry__

    (tmp_path / "needs_more.py").write_text("import graphloom_no_such_module\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._optional("needs_more")
    assert __spark_entry__._optional("graphloom_no_such_module") is None
