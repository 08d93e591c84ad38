"""The package reaches Python workers that start elsewhere and without a path to it."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_workers_get_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from sectorpulse.session import local_session
spark = local_session("shipped", 2, 2)
print("rows", entry.queries()["dedupe_fuzzy"](spark, "/root/testdata/sf0.001").count())
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True)
    assert found.returncode == 0 and "rows " in found.stdout, found.stderr[-2000:]
