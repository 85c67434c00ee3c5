"""What lies at a path, on whatever file system the path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is directly in a folder; nothing if it is missing."""
    files, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Give a finished folder its name, at once; an error if another has it."""
    files, at = _at(spark, path)
    if files.exists(at) or not files.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), at):
        raise FileExistsError(f"{path} was written by another")


def remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
