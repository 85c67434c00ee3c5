"""Where intermediate results go: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path in the shared folder.  Only a local session without that setting (tests, one machine) gets a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not got.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = got.get() if got.isDefined() else tempfile.mkdtemp(prefix="barloom-")
    return f"{root.rstrip('/')}/barloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Bytes of text that one group of an exchange holds at most, on average
GROUP_BYTES = 64 << 20


def partitions(spark: SparkSession, rows: DataFrame | None = None, column: str = "text") -> int:
    """The session's number of shuffle partitions, or more where the bytes of a column of rows ask for it (one pass over that column)."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is None:
        return least
    size = rows.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(least, -(-size // GROUP_BYTES))


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Let Arrow batches of this session hold at most so many bytes: Spark's 64 MB a task are much beside Python workers.

    Results do not depend on it.  The operators themselves leave the session as it is; queries and the pipeline call this.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
