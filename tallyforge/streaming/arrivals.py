"""Order files as they arrive: each micro-batch of new files is cleaned and upserted like a run of its own.

The stream's checkpoint decides which files are new. A batch that is replayed after a failure has the same files and the
same run id, and both stores upsert by key, so it changes nothing twice.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators import job, store
from tallyforge.schemas import RAW_RECORD
from tallyforge.sources import order_files
from tallyforge.sources.paths import n_bytes
from tallyforge.sources.scratch import job_scratch, scratch_dir


def start(
    spark: SparkSession, inbox: str, checkpoint: str, good: store.Table, bad: store.Table, run: str, stamp: str, files_per_batch: int = 100, contract: str = "quarantine", metrics: str | None = None
) -> StreamingQuery:
    """Process what ``inbox`` holds now, ``files_per_batch`` files at a time, and stop. Run ids are ``<run>-<batch>``.

    A batch takes the batch job's steps: contract (a row that breaks it is quarantined, or fails the batch), balance of raw,
    classified and stored rows, and a row of metrics below ``metrics``.
    """
    name = inbox.rstrip("/").rpartition("/")[2]

    def each(arrived: DataFrame, number: int) -> None:
        files = [r["file_path"] for r in arrived.distinct().collect()]  # at most ``files_per_batch``
        if not files:
            return
        began, id_run = time.monotonic(), f"{run}-{number}"
        with job_scratch(spark):
            rows = order_files.numbered(order_files.scan(spark, files)).withColumns({"id_run": F.lit(id_run), "source_file": F.lit(name)})
            settled = job.settle(rows, f"{scratch_dir(spark)}/classified", stamp, contract)
            stored = job.keep(settled, good, bad, id_run)
        if metrics:
            job.log(spark, metrics, id_run, stamp, (name, sum(n_bytes(spark, f) for f in files)), settled, stored, time.monotonic() - began)

    stream = spark.readStream.schema(RAW_RECORD).option("header", True).option("quote", '"').option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(inbox)
    paths = stream.selectExpr("_metadata.file_path as file_path")
    return paths.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
