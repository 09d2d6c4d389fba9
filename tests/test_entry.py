import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_point

REPO = Path(__file__).resolve().parent.parent


def test_entry_has_a_stable_schema(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["source_group", "n_items", "n_sources", "first_item"] and df.count() >= 1


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_the_rest_works_without_the_llm_parts(tmp_path):
    shutil.copytree(REPO / "stratal", tmp_path / "stratal", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'daily_seal' in q and 'pipeline' not in q and not any(n[:2] == 'op' and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_other_import_errors_are_not_swallowed(tmp_path):
    shutil.copytree(REPO / "stratal", tmp_path / "stratal", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "stratal/llm").mkdir()
    (tmp_path / "stratal/llm/__init__.py").write_text("")
    (tmp_path / "stratal/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=False)
    assert run.returncode and b"a_module_that_is_not_there" in run.stderr
