import os
import subprocess
import sys

UNSET = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from tessera.llm.shared import shared_dir, stored
assert stored(spark.range(3), "x").count() == 3 and shared_dir(spark) == shared_dir(spark)
print("PLACE", shared_dir(spark))
"""


def test_without_a_shared_folder():
    """A local session gets a folder of its own, which goes with it."""
    got = subprocess.run([sys.executable, "-c", UNSET], capture_output=True, text=True, timeout=200)
    assert got.returncode == 0, got.stderr[-2000:]
    assert not os.path.exists(got.stdout.partition("PLACE file://")[2].strip())
