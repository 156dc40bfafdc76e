"""Cut the lineage of an iterative plan, and write what is read again, in the folder that the cluster shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the folder of setCheckpointDir().

    Where neither is set, a local session gets FALLBACK_DIR; on a cluster that would be each machine's own, so it's an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = FALLBACK_DIR
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    folder = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(hadoop)
    store.deleteOnExit(hadoop)
    return f"{folder}/{what}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
