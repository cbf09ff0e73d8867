"""Stored tables on sessions with and without a shared folder, each in an interpreter of its own."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PLAIN = """
import os
from pyspark.sql import SparkSession
from siftline.scratch import dropped, shared_root, stored
spark = SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false"){more}.getOrCreate()
one = stored(spark.range(3), "a")
two = stored(spark.range(4), "b")
assert one.count() == 3 and two.count() == 4
assert one.stored_at.startswith(shared_root(spark) + "/siftline/a-") and shared_root(spark) == shared_root(spark)
dropped(spark, one)
left = os.listdir(shared_root(spark).removeprefix("file://") + "/siftline")
assert len(left) == 1 and left[0].startswith("b-"), left
print("ROOT", shared_root(spark))
"""


def run(code: str, conf_dir, **env) -> subprocess.CompletedProcess:
    env = os.environ | {"SPARK_CONF_DIR": str(conf_dir), "PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"} | env
    return subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)


def test_a_plain_session_gets_a_folder(tmp_path):
    done = run(PLAIN.format(master="local[2]", more=""), tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "ROOT file:///" in done.stdout


def test_the_session_s_own_folder_is_taken(tmp_path):
    done = run(PLAIN.format(master="local[2]", more=f'.config("spark.checkpoint.dir", "file://{tmp_path}/shared")'), tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"ROOT file://{tmp_path}/shared" in done.stdout


def test_a_cluster_without_a_folder_is_an_error(tmp_path):
    code = """
from types import SimpleNamespace
from siftline.scratch import shared_root
conf = SimpleNamespace(get=lambda key, default=None: default)
for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
    try:
        shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x")))
        raise SystemExit(master + " got a folder")
    except ValueError:
        pass
"""
    done = run(code, tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
