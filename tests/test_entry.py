"""The driver's entry points, also from a folder that workers cannot import from."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
q = __spark_entry__.queries()
n = [q[name](spark, "/root/testdata/sf0.001").count() for name in ("D4_similarity", "D11_knn", "D4_similarity")]
assert n[0] == n[2] > 0 and n[1] > 0
assert __spark_entry__.entry(spark).count() > 0
print("reached")
"""


def test_queries_run_from_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "reached" in done.stdout, done.stderr[-3000:]


def test_names_match():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
