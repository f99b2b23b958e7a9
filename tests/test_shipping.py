"""Task code must reach executors that have no copy of the package."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in ["bpe_count", "ignore_rules", "file_tree_scan"]:
    assert entry.queries()[name](spark, sys.argv[3]).count() > 0
"""


def test_queries_from_another_folder(tmp_path):
    from tests.conftest import SF

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    command = [sys.executable, "-c", SCRIPT, root, str(tmp_path / "shared"), SF]
    subprocess.run(command, cwd=tmp_path, env=environment, check=True, timeout=300)
