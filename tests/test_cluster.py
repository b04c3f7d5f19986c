"""Queries that failed on a cluster for want of the package's copy give all their rows there."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from voxloom.session import ROOT

RUN = """
import json, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,2,1536]").config(map={{
    "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "768m", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC",
    "spark.checkpoint.dir": "file://{tmp}/shared", "spark.sql.warehouse.dir": "{tmp}/warehouse"}}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
spark.sparkContext.master = "spark://127.0.0.1:7077"  # as the package sees it where no machine is shared
import __spark_entry__
queries = __spark_entry__.queries()
for name in {names!r}:
    try:
        print(json.dumps([name, len(queries[name](spark, "/root/testdata/sf0.001").collect())]))
    except Exception as e:
        print(json.dumps([name, str(e)[:2000]]))
"""

#: Finding, query, rows on sf0.001.
CASES = [
    ("F2", "op3_ngram_jaccard", 200),
    ("F3", "op5_lm_scoring", 200),
    ("F4", "op8_fingerprints", 200),
    ("F5", "op11_divergence_audit", 1502),
    ("F6", "op12_importance_resampling", 200),
    ("F9", "c1_salvage_each_kind", 1000),
    ("F10", "c2_migrations", 1000),
    ("F11", "c3_merged_defaults", 200),
    ("F12", "c4_prompt_lists", 25),
    ("F13", "d1_append_and_retain", 242),
    ("F14", "c5_set_field", 1000),
    ("F15", "d2_d4_change_events", 5),
    ("F16", "d2_update_texts", 1000),
    ("F17", "d3_toggle_saved", 1000),
    ("F18", "d4_delete", 997),
    ("F19", "d4_ids_are_given_once", 768),
    ("F20", "d6_merge_changes", 15),
    ("F24", "f12_verify_objects", 1),
    ("F25", "f13_flatten_translations", 100),
    ("F26", "f13_translation_audit", 16),
    ("F30", "f1_speed_score", 200),
]


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("cluster")
    home = tmp / "home"  # executors work in a folder of Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp / "local")}
    env["PYTHONPATH"] = str(Path(pyspark.__file__).parents[1])  # Spark alone
    (tmp / "elsewhere").mkdir()
    run = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, tmp=tmp, names=[c[1] for c in CASES])], env=env, cwd=tmp / "elsewhere", capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    return dict(json.loads(line) for line in run.stdout.splitlines() if line.startswith("["))


@pytest.mark.parametrize("finding, query, rows", CASES, ids=[c[1] for c in CASES])
def test_executors_without_the_package_run(found, finding, query, rows):
    assert found[query] == rows
