"""The package on executors that do not have it, and the folder for tables in between."""

import os
import subprocess
import sys

import pytest

from dishlens import config

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DIR = "/root/testdata/sf0.001"
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["dense_topk"](spark, {dir!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_a_session_started_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, dir=DIR)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 50" in done.stdout, done.stderr[-2000:]


class Unset:
    """A session without the setting."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master, applicationId = "local[2]", "app-of-test"

        @staticmethod
        def getConf():
            return {}


def test_the_folder_has_to_be_named(tmp_path):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        config.work_dir(Unset, "x")
    config.use_own_work_dir(Unset, lambda: str(tmp_path))
    assert config.work_dir(Unset, "x").startswith(f"{tmp_path}/x-")
    Unset.sparkContext.applicationId, Unset.sparkContext.master = "other", "spark://host:7077"
    config.use_own_work_dir(Unset, lambda: str(tmp_path))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        config.work_dir(Unset, "x")
