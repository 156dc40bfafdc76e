"""What each task of a cluster sees, and order-free checks of results."""

from __future__ import annotations

import socket

from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rank_hosts(spark: SparkSession, ranks: int) -> DataFrame:
    """(rank, size, host) of each task of a barrier stage; needs ``ranks`` free slots."""
    def gather(_):
        context = BarrierTaskContext.get()
        names = context.allGather(socket.gethostname())
        yield context.partitionId(), len(names), names[context.partitionId()]

    rows = spark.sparkContext.parallelize(range(ranks), ranks).barrier().mapPartitions(gather)
    return spark.createDataFrame(rows, "rank int, size int, host string")


def checksum(df: DataFrame) -> DataFrame:
    """One row (n, sum): the same for the same rows in any order."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum"))
