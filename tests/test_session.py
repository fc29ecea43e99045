"""The checkpoint folder on a cluster: a path without a file system is on the default one."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
from pyspark.sql import SparkSession
from stepgrove import session
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
        "spark.executor.memory": "512m", "spark.checkpoint.dir": sys.argv[1], "spark.local.dir": sys.argv[2]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
path, rows = session.store(spark.range(0, 1000, 1, 4))
assert rows == 1000 and path.startswith("file:"), path
assert spark.read.parquet(path).count() == 1000
session._SHARED.clear()
session._is_shared = lambda spark, folder: False
try:
    session.store(spark.range(1))
    raise AssertionError("a folder that is not shared must be refused")
except ValueError:
    pass
spark.stop()
"""


def test_a_plain_path_on_a_cluster(tmp_path):
    env = {**os.environ, "PYTHONPATH": HERE, "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", CODE, str(tmp_path / "shared"), str(tmp_path / "local")], cwd=tmp_path, env=env, check=True, timeout=300)
