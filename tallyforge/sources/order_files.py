"""Order files: scan with the fixed schema, gapless row numbers without moving rows, lineage, raw store, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.schemas import RAW_COLUMNS, RAW_RECORD
from tallyforge.sources.paths import PARQUET
from tallyforge.sources.scratch import materialize


#: Up to so many splits (a path and four numbers each) their offsets are broadcast.
BROADCAST_SPLITS = 100_000


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The 17 text columns; quoted fields may hold quotes (doubled) and commas, not line ends. Blank fields are null."""
    return spark.read.schema(RAW_RECORD).option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def numbered(rows: DataFrame, out: str = "source_row_number") -> DataFrame:
    """``rows`` of a file scan with ``out`` = 1..N in the order of file and place in the file.

    Rows of a split are consecutive in Spark's increasing id, so only a count and a least id for each split are gathered;
    their prefix sums go back to the rows by a join with one row a split, by broadcast while those are few. ``rows`` must
    be a plain scan: both passes have to see the same splits.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    # written, so that the file is read for them once
    splits = materialize(placed.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__least")), "splits")
    # one row a split: the single task of this window sees split counts, not rows
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__block", "__least", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    few = splits.count() <= BROADCAST_SPLITS
    joined = placed.join(F.broadcast(offsets) if few else offsets, ["__file", "__block"])
    return joined.withColumn(out, (F.col("__before") + F.col("__id") - F.col("__least") + 1).cast("long")).drop("__file", "__block", "__id", "__least", "__before")


def with_lineage(rows: DataFrame, id_run: str, source_file: str, ingested_at: str, engine: str = "spark") -> DataFrame:
    """Run, file, row number, UTC ingest time and engine beside the nested raw record; null fields become blanks there."""
    record = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in RAW_COLUMNS]).alias("raw_record")
    return rows.select(F.lit(id_run).alias("id_run"), F.lit(source_file).alias("source_file"), "source_row_number", F.lit(ingested_at).alias("ingested_at"), F.lit(engine).alias("engine_used"), record)


def append_raw(raw: DataFrame, path: str) -> None:
    raw.write.mode("append").partitionBy("id_run").parquet(path, **PARQUET)


def read_raw(spark: SparkSession, path: str, id_run: str) -> DataFrame:
    """One run's rows by partition pruning, flattened for the rules."""
    return spark.read.parquet(path).where(F.col("id_run") == id_run).select("raw_record.*", "id_run", "source_file", "source_row_number")


def ingest(spark: SparkSession, csv: str, raw_path: str, id_run: str, ingested_at: str) -> None:
    append_raw(with_lineage(numbered(scan(spark, csv)), id_run, csv.rstrip("/").rpartition("/")[2], ingested_at), raw_path)


def sample(spark: SparkSession, csv: str, out: str, rows: int) -> None:
    """The first ``rows`` rows in file order as CSV with a header."""
    if rows < 1:
        raise ValueError("rows must be positive")
    first = numbered(scan(spark, csv)).where(F.col("source_row_number") <= rows)
    first.orderBy("source_row_number").select(*RAW_COLUMNS).write.option("header", True).option("quote", '"').option("escape", '"').csv(out)


def preview(raw: DataFrame, rows: int = 15) -> DataFrame:
    return raw.select("source_row_number", "raw_record.*").orderBy("source_row_number").limit(rows)
