"""Scratch folders that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tallyforge.sources.paths import PARQUET, remove

_JOB: ContextVar[str | None] = ContextVar("job", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names in ``spark.checkpoint.dir``.

    Without the setting, a temporary folder takes its place where all runs in one process, as in tests; on a cluster that
    is an error, as no folder of one machine would do.
    """
    if job := _JOB.get():
        return f"{job}/{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/tf-{uuid.uuid4().hex}"


@contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables of the body lie in one folder, which goes when the body ends. Its results must be stored elsewhere."""
    folder = scratch_dir(spark)
    before = _JOB.set(folder)
    try:
        yield
    finally:
        _JOB.reset(before)
        remove(spark, folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path, **PARQUET)
    return spark.read.schema(df.schema).parquet(path)
