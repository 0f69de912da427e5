"""The registered queries of this subpackage: each applies an operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, hard_negatives, language_id, near_dup, packing, periodic_runs, pii, quality_model, quality_rules, sharding, token_files, toxicity, warc
from tallyforge.llm.common import doc_fold, read_table, scratch_dir, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(packing.pack(read_table(spark, sf_dir, "documents"), word_tokenizer_path()))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_values")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_fold("doc_id", 3) == 1
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.verdicts(quality_rules.ledger(read_table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_fold("doc_id", 4) == 2
    scored = quality_model.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages")).drop("payload")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_fold("doc_id", 5) == 0
    scored = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "passages")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_repeats(read_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digest(periodic_runs.periodic_runs(docs))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.whole_vectors(read_table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(read_table(spark, sf_dir, "documents"), word_tokenizer_path(), f"{scratch_dir(spark)}/tokens")
    return token_files.token_digest(token_files.read_documents(files))


def lean(query: Query) -> Query:
    """The query in a session of small batches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    every = (op1_packing, op2_pii, op3_language_id, op4_quality_rules, op5_quality_model, op6_near_dup, op7_decontaminate, op8_warc, op9_sharding, op10_toxicity, op11_periodic_runs, op12_hard_negatives, op13_token_files)
    return {q.__name__: lean(q) for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
