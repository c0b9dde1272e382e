"""The package reaches Python workers wherever the driver was started."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("rows", entry.queries()["beta_code_readings"](spark, sys.argv[2]).limit(5).count())
"""


def test_functions_run_from_another_folder(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 5" in done.stdout, done.stderr[-2000:]
