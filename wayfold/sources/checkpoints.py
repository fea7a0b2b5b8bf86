"""Reliable cut of lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` when it is set; where it is unset (tests on one machine) make a folder of
    our own.  A cluster without a shared folder is an error, since its executors can't see a local one."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-wayfold-"))


def cut(df: DataFrame) -> DataFrame:
    """A checkpointed copy of ``df``: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext._jsc.sc()
    folder = context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else spark.conf.get("spark.checkpoint.dir")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like :func:`cut`, for tables of which later steps read
    some columns only."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table counts as small.
SMALL_ROWS = 100_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", most: int = SMALL_ROWS) -> DataFrame:
    """``big`` joined with a table that is usually small: it is checkpointed and counted, and broadcast only
    if it has at most ``most`` rows; otherwise Spark joins by shuffles."""
    held = cut(small)
    return big.join(F.broadcast(held) if held.count() <= most else held, on, how)
