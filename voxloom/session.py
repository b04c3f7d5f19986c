"""Session helpers."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
BATCH, DEFAULT_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def _one_process(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


@functools.cache
def _package() -> str:
    """A zip of this package. Executors fetch it from the driver when their first task starts, late ones later still, so it stays until the process ends."""
    folder = tempfile.mkdtemp(prefix="voxloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/voxloom-package.zip", "w") as copy:
        for file in sorted(Path(ROOT, "voxloom").rglob("*.py")):
            copy.write(file, file.relative_to(ROOT))
    return f"{folder}/voxloom-package.zip"


def on_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package: by its path in local mode, elsewhere by a copy that Spark sends to the executors.

    Whole texts are long: unless another size is set, fewer rows go to a worker at once.
    """
    if spark.conf.get(BATCH, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH, BATCH_ROWS)
    context = spark.sparkContext
    if not _one_process(spark):
        if not any(name.startswith("voxloom-") for name in context._python_includes):
            context.addPyFile(_package())
        return spark
    env = context.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        if not _one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="voxloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """df after a round trip through Parquet in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/voxloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
