"""Each query on Python workers that have loaded nothing before."""

import os
import subprocess
import sys

import pytest

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.python.worker.reuse", "false").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from tessera.llm import queries
sf = sys.argv[1]
for name, query in queries.QUERIES.items():
    query(spark, sf).write.format("noop").mode("overwrite").save()
    print("done", name, flush=True)
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_queries_on_fresh_workers(sf):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    run = subprocess.run([sys.executable, "-c", SCRIPT, sf], env=env, cwd=root, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0 and run.stdout.count("done") == 10, run.stdout + run.stderr[-3000:]
