"""The registry must import without a JVM and with PySpark loaded from its zip."""

import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_imports_from_pyspark_zip():
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = [os.path.join(lib, f) for f in sorted(os.listdir(lib)) if f.endswith(".zip")]
    code = ("import pyspark; assert '.zip' in pyspark.__file__, pyspark.__file__\n"
            "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True,
                         env=os.environ | {"PYTHONPATH": os.pathsep.join([*zips, ROOT])}, timeout=120)
    assert out.returncode == 0, out.stderr
    n, m = map(int, out.stdout.split())
    assert n >= 123 and m >= 109
