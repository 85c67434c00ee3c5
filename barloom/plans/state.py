"""The folder that the cluster names in spark.checkpoint.dir: lineage is cut there, and other state kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without one gets a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined() and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own.get() if own.isDefined() else tempfile.mkdtemp(prefix="barloom-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_root(df.sparkSession))
    return df.checkpoint(eager=True)
