"""Cutting lineage between the rounds of an iteration, and dealing small inputs to all cores."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables are sent to all executors if they, known before, are no larger.
BROADCAST_BYTES = 32 << 20


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the folder of ``spark.checkpoint.dir``; a temporary one only if unset in local mode."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="kmerloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """``df``, cheap to read, to be broadcast if it is small enough to be sent to all executors."""
    length = {"string": lambda c: F.length(c), "array": lambda c: 8 * F.size(c)}
    each = [F.coalesce(length.get(t.split("<")[0], lambda c: F.lit(0))(F.col(n)), F.lit(0)) + 24 for n, t in df.dtypes]
    size = df.agg(F.sum(sum(each[1:], each[0]).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its files have fewer; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
