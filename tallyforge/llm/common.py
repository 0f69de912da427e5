"""Helpers shared by the operators: table access, scratch tables, word and byte helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.scratch import materialize, scratch_dir  # noqa: F401  (operators take them from here)

#: Bytes that part words: space and 0x09 to 0x0D. ``bytes.split()`` parts at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_fold(doc_id: str | F.Column, n: int) -> F.Column:
    """crc32(doc_id as text) mod n; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def small_batches(spark: SparkSession) -> None:
    """Let tasks hand little to Python at a time, as texts may be long and a batch is held on both sides. A setting of the
    whole session, so operators leave it alone; the registered queries and the pipeline make it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers, which outlive their tasks, give back what a task no longer needs."""

    def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # only the GNU C library has it
                trim(0)

    return df.mapInArrow(thrifty, schema)


def text_parts(batch: pa.RecordBatch, most: int = 1 << 20, name: str = "text") -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of a batch's texts, of about ``most`` bytes each, as UTF-8; null counts as empty. Only one run is in Python at
    a time, however large the batch is."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    edges = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(column)] if len(column) else [0]
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        yield slice(start, stop), [b or b"" for b in column.slice(start, stop - start).to_pylist()]


def spread(df: DataFrame, size: F.Column, bytes_per_part: int, *keys: F.Column) -> DataFrame:
    """Repartition by ``keys`` into parts of about ``bytes_per_part``; the total comes from one narrow aggregate."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    return df.repartition(max(1, -(-int(total) // bytes_per_part)), *keys)
