"""Intermediate results at a place every executor can read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; one is picked only where none is named.

    A folder of this machine would do for local runs alone, so a cluster
    without the setting is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="crawlframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """Where this application puts what it stores between jobs."""
    return f"{shared_folder(spark)}/crawlframe/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application stored between jobs; results that were read from there are gone too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it with a fresh plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
