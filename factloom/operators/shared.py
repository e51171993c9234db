"""Cutting lineage in loops, and folders that all machines share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``. Where none is named, a folder of this
    machine in local mode, as in tests; on a cluster an error, since its machines don't share one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix=f"{name}-")


#: Rows of a shuffled partition at most, about. Compressed tables come in few files, and the session's number of partitions
#: may be meant for these.
ROWS = 250_000


def parts(spark: SparkSession, rows: int) -> int:
    """How many partitions so many rows are shuffled to: the session's number, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS))


def distinct(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Distinct by ``columns``, of about so many rows. Many are dealt out first, so that no task holds all of a few files."""
    n = parts(df.sparkSession, rows)
    return (df.repartition(n, *columns) if rows > ROWS else df).dropDuplicates(list(columns))


def cut(df: DataFrame, rows: int = 0) -> DataFrame:
    """Checkpoints to the folder that the cluster names in ``spark.checkpoint.dir``, or see ``shared_folder``. ``rows``: about
    how many rows the largest of its shuffles has, if known."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoint"))
    name = "spark.sql.shuffle.partitions"
    before, n = spark.conf.get(name), parts(spark, rows)
    if n == int(before):
        return df.checkpoint(eager=True)
    spark.conf.set(name, n)
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)
