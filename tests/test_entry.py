"""The driver entry, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as driver

ROOT = Path(driver.__file__).resolve().parent


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["product_id", "bucket", "depth"] and df.count() == 200


def test_every_library_query_has_sql():
    from facetmill.plans import catalogue

    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
    assert set(catalogue.queries()) <= set(driver.queries())


def test_without_llm(tmp_path):
    shutil.copytree(ROOT / "facetmill", tmp_path / "facetmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as d; q = d.queries(); assert 'bucket_assign' in q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q; d.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=60)
