"""Queries with Python functions run from any working directory, on workers that know nothing of the repository."""

import os
import subprocess
import sys
import tempfile

from data_paths import ROOT, SMALL

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
print("rows", E.queries()["reserve_stock_taken"](spark, {data!r}).count())
print("rows", E.queries()["cart_stream_errors"](spark, {data!r}).count())
"""


def test_python_backed_queries_run_from_another_folder():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, data=SMALL)], cwd=tempfile.mkdtemp(),
                         env=env, capture_output=True, text=True, timeout=600)
    rows = [int(x.split()[1]) for x in out.stdout.splitlines() if x.startswith("rows")]
    assert len(rows) == 2 and min(rows) > 0, out.stderr[-2000:]
