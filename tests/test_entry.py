"""The driver's contract, with and without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


@pytest.mark.parametrize("gone", [["paperloom/llm", "corpus_pipeline.py"], ["paperloom/llm"]])
def test_imports_without_the_subpackage(tmp_path, gone):
    for n in ("paperloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / n).exists():
            (shutil.copytree if (ROOT / n).is_dir() else shutil.copy)(ROOT / n, tmp_path / n)
    for n in gone:
        shutil.rmtree(tmp_path / n) if (tmp_path / n).is_dir() else (tmp_path / n).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'precheck_category_by_db' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_a_broken_dependency_is_no_absence(tmp_path):
    shutil.copytree(ROOT / "paperloom", tmp_path / "paperloom")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode and "a_module_that_is_not_there" in done.stderr


def test_workers_find_the_package_from_anywhere(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
e.queries()["string_similarity"](s, "/root/testdata/sf0.001").collect()
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
