"""Jobs must run where the package is not installed."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from sieveline.session import local_session
spark = local_session("2", 2, "2g")
for name in ("function_complexity", "shap_seeded", "lime_seeded", "stream_stuck_files"):
    assert e.queries()[name](spark, sys.argv[1]).count() > 0, name
spark.stop()
"""


def test_workers_do_not_import_the_package(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB, sf_dir], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
