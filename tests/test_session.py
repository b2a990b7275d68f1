import os
import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from forage.session import cut, shared_folder
first = shared_folder(spark)
assert first and shared_folder(spark).split(":")[-1].startswith(first.split(":")[-1])
assert cut(spark.range(5), "numbers").count() == 5
print("folder works")
"""


def test_a_local_session_that_names_no_folder_gets_one(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    found = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "folder works" in found.stdout, found.stderr[-2000:]
