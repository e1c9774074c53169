"""Executors need nothing from this package installed: the only function
shipped to Python workers (the block scorer) is self-contained. Checked by a
driver started outside the repository, loading the entry file by path."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util, sys
sys.path.insert(0, {ROOT!r})
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, '__spark_entry__.py')!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
print("ROWS", E.queries()["top_n_per_user"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_do_not_import_the_package():
    cwd = tempfile.mkdtemp(prefix="run-deploy-")   # a fresh folder, left in place
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 500" in out.stdout, out.stderr[-2000:]
