"""Joins that choose their strategy by a count made first, and lineage cuts in the shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one BIGINT column that are small enough to copy to every executor (16 bytes each there).
BROADCAST_KEYS = 250_000


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir``, which all executors share, and read from there.

    Only where the session names no folder and runs on this machine alone, as in tests, one is made here; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="webloom-checkpoint-"))
    return df.checkpoint(eager=True)


def rows_with_keys(df: DataFrame, keys: DataFrame, key: str, limit: int = BROADCAST_KEYS, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on one column; ``keys`` is broadcast if it counts at most ``limit`` rows, else shuffled.

    ``keys`` should be cheap to read again, as a checkpoint is.
    """
    n = keys.limit(limit + 1).count()
    return df.join(F.broadcast(keys) if n <= limit else keys, key, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
