"""The package reaches executors that can't import it from where the driver does."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

from voxloom.session import ROOT

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map={{
    "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "512m", "spark.checkpoint.dir": "file://{tmp}/shared", "spark.sql.warehouse.dir": "{tmp}/warehouse"}}).getOrCreate()
spark.sparkContext.master = "spark://127.0.0.1:7077"  # as the package sees it where no machine is shared
import __spark_entry__
queries = __spark_entry__.queries()
for name in ("c4_prompt_lists", "op8_fingerprints"):
    print(name, queries[name](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_of_a_cluster_get_the_package(tmp_path):
    home = tmp_path / "home"  # executors work in a folder of Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    env["PYTHONPATH"] = str(Path(pyspark.__file__).parents[1])  # Spark alone
    (tmp_path / "elsewhere").mkdir()
    run = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, tmp=tmp_path)], env=env, cwd=tmp_path / "elsewhere", capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.split() == ["c4_prompt_lists", "25", "op8_fingerprints", "200"]
