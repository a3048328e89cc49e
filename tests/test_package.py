"""The package reaches Python workers that share neither path nor folder with the driver."""

import os
import subprocess
import sys

from .conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("entry_module", "{root}/__spark_entry__.py")
E = importlib.util.module_from_spec(spec)
spec.loader.exec_module(E)
from credsight.session import get_session
spark = get_session(master="local[2]")
print("rows", E.queries()["F12_build_hash_chain"](spark, "{sf}").count())
"""


def test_python_workers_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf=SF_SMALL)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[-1]) > 0


def test_shipped_once(spark):
    from credsight.session import ship_package

    ship_package(spark)
    before = spark.sparkContext.listFiles
    ship_package(spark)
    assert len(spark.sparkContext.listFiles) == len(before)
