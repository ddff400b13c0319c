"""Checkpoint folder of a session without any configuration; intermediate tables."""
from __future__ import annotations

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PLAIN = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from vigil.plans.materialize import materialize
from vigil.session import checkpoint_dir, remove_intermediate, tables_dir
assert materialize(spark.range(5), "plain").count() == 5
assert checkpoint_dir(spark) == checkpoint_dir(spark)
remove_intermediate(spark)
import os
assert not os.path.exists(tables_dir(spark).removeprefix("file:"))
print("fine")
"""


def test_plain_local_session():
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")}
    env |= {"SPARK_CONF_DIR": tempfile.mkdtemp(prefix="vigil-empty-conf-"), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-2000:]
