"""The package reaches the executors' Python wherever the driver was started."""

import os
import shutil
import subprocess
import sys

import pytest

from lorekeep import plans

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", __spark_entry__.queries()["vector_top_k_all"](spark, {FOLDER!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_workers_import_from_another_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=240
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows 150" in done.stdout


WITHOUT = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
names = __spark_entry__.queries()
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("names", len(names), any(n == "pipeline" or n.startswith("op1") for n in names), set(__spark_entry__.oracle_sql()) <= set(names))
print("rows", names["index_stats"](spark, %r).count())
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_training_data_operators(tmp_path, pipeline):
    """As after both folders were deleted, whether or not the pipeline over them was left behind."""
    for name in ("lorekeep", "tests", "tools", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source) and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(source, tmp_path / name)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", WITHOUT % FOLDER], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=240
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"names {len(plans.QUERIES)} False True" in done.stdout and "rows 4" in done.stdout
