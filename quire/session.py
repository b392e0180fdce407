"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; a cluster may ship it with --py-files too."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (env.get("PYTHONPATH"), ROOT) if p)
    return spark


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))  # one machine: any folder is shared
    return jsc.getCheckpointDir().get()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df):
    """Compute once and cut the lineage in the folder of spark.checkpoint.dir."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)
