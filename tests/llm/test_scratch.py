"""The shared folder is found, or made, without changing the session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
from pyspark.sql import SparkSession
from quillstream.llm.common import materialize
from quillstream.session import shared_folder
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark)
assert materialize(spark.range(7), "x").count() == 7
print("FINE")
"""


def test_no_folder_is_named(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    said = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert "FINE" in said.stdout, said.stderr[-2000:]
