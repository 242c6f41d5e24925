"""The entry points work for a driver that starts elsewhere and has no copy of the package."""

import pathlib
import subprocess
import sys

from tests.conftest import DATA

SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {scratch!r}).getOrCreate()
print("rows", module.queries()["snk_09_forest_table"](spark, {data!r}).count())
spark.stop()
"""


def test_tasks_need_no_installed_package(tmp_path):
    entry = pathlib.Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    script = SCRIPT.format(entry=str(entry), scratch=str(tmp_path / "scratch"), data=str(DATA))
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "rows 200" in done.stdout, done.stderr[-2000:]
