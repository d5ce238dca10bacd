"""The driver's entry, with the training-data folders and without them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
RUN = """
import sys
import __spark_entry__ as e
from quire.plans import catalog
found = e.queries()
assert set(catalog.queries()) <= set(found) and set(e.oracle_sql()) <= set(found)
assert not [k for k in found if k.startswith("op") or k == "pipeline"], found
if len(sys.argv) > 1:
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    assert found["route_queries"](spark, sys.argv[1]).count() > 0
print("fine")
"""


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_the_training_data_folders(tmp_path, pipeline_too):
    skip = {".git", "llm", "__pycache__", ".pytest_cache", *(["corpus_pipeline.py"] if pipeline_too else [])}
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda _, names: skip & set(names))
    data = [DATA] if os.path.isdir(DATA) and not pipeline_too else []
    done = subprocess.run([sys.executable, "-c", RUN, *data], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode == 0 and done.stdout.strip().endswith("fine"), done.stderr[-2000:]
