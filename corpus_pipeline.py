"""Corpus preparation as five stages over ``documents``: each applies one operator to all that the one before it kept.

Filters decide on each row by itself, by a key of the stage that tells rows apart where doc_id is repeated or null; other
columns, clashing names included, pass through. Texts are not shuffled by a filter while the rejected keys fit a broadcast
of stated size.

Edge cases, stage by stage: toxicity gives null and empty texts the score of no evidence; near-duplicates link them with
nothing, so they stay, and of repeated rows one stays; decontamination finds nothing in them; PII leaves them as they are;
packing makes each a single end token. Texts of any length are read whole by every stage, ties are broken by the smallest
key, and an empty table goes through as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, near_dup, packing, pii, toxicity
from tallyforge.llm.catalog import word_tokenizer_path
from tallyforge.llm.common import doc_fold, materialize, read_table, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Up to so many rejected keys (8 bytes each) reach the documents by broadcast, beyond it by a shuffle join.
BROADCAST_IDS = 2_000_000
#: The column of a stage's row keys.
ROW = "stage_row_key"


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key for each row: doc_id where that tells all rows apart, else a number, written once."""
    number = F.col("doc_id").cast("long")
    unclear = docs.select(number.alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("c")).where("doc_id is null or c > 1")
    if unclear.isEmpty():
        return docs.withColumn(ROW, number)
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def by_row(rows: DataFrame) -> DataFrame:
    """What operators read, with the row key for an id."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def without(rows: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """``rows`` but those whose key is among the doc_id of ``rejected``; the keys go."""
    ids = materialize(rejected.select(F.col("doc_id").alias(ROW)).distinct(), name)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, ROW, "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose score is 0.5 or more go; learnt from the labels outside the held-out fold."""
    rows = keyed(docs, "toxicity_rows")
    known = read_table(spark, sf_dir, "labels").where(doc_fold("doc_id", 5) != 0).select(F.col("doc_id").cast("long").alias("id"), "toxic")
    # a label holds for each row of its document
    known = rows.select(F.col("doc_id").cast("long").alias("id"), F.col(ROW).alias("doc_id")).join(known, "id", "right").drop("id")
    scored = toxicity.score_toxicity(by_row(rows), materialize(known, "row_labels"), F.lit(True))
    return without(rows, scored.where("predicted = 1"), "toxic_rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: of documents linked by five-word shingles at 0.8, one row with the smallest id stays. A row without
    doc_id does not go for one that has it: of such rows, too, one of those linked stays."""
    rows = keyed(docs, "duplicate_rows")
    found = near_dup.near_duplicates(by_row(rows), width=5, percent=80).select(F.col("doc_id").alias(ROW), "component_id")
    found = materialize(found.join(rows.select(ROW, F.col("doc_id").cast("long").alias("id")), ROW), "row_components")
    least = found.groupBy("component_id", F.isnull("id").alias("nameless")).agg(F.min(F.struct("id", ROW)).alias("least"))
    return without(rows, found.join(least.select(f"least.{ROW}"), ROW, "left_anti").select(F.col(ROW).alias("doc_id")), "duplicates")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark item, within a quarter of its words, go."""
    rows = keyed(docs, "contamination_rows")
    return without(rows, decontaminate.contaminated(by_row(rows), read_table(spark, sf_dir, "benchmark")), "contaminated_rows")


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal values become pseudonyms of their format; ``n_chars`` follows the text where it changed."""
    out = pii.pseudonymize(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_values") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: training sequences of at most 2048 tokens, a row a piece. The executors still hold what earlier stages
    needed, so the word table and the runs of texts are small."""
    return packing.pack(docs, word_tokenizer_path(), group_tokens=500_000, part_bytes=16 << 20, table_words=20_000, run_bytes=256 << 10)


def lean(stage: Stage) -> Stage:
    """The stage in a session of small batches."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", lean(drop_toxic)),
    ("near_duplicates", lean(drop_near_duplicates)),
    ("decontamination", lean(drop_contaminated)),
    ("pii", lean(pseudonymize)),
    ("packing", lean(pack_sequences)),
]

#: Trained models and hash families have no SQL form. Tests hold the operators against brute force, plain networks and held-out
#: labels, and the pipeline's stages against the operators.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
