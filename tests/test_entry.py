"""The entry module works with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_the_optional_parts(tmp_path, pipeline):
    shutil.copytree(os.path.join(ROOT, "tablewright"), tmp_path / "tablewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py"))):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    asked = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", asked], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_other_missing_modules_are_errors(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tablewright"), tmp_path / "tablewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import not_there_at_all\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True)
    assert done.returncode and b"not_there_at_all" in done.stderr
