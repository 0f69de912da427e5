from pyspark.sql import functions as F

from tallyforge.operators import store
from tallyforge.plans import models
from tallyforge.schemas import RAW_COLUMNS
from tallyforge.streaming import arrivals


def test_files_are_taken_once(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    rows = models.dirty(spark, "/root/testdata/sf0.001").where("source_row_number <= 300").select(*RAW_COLUMNS, "source_row_number").cache()
    write = lambda part: rows.where(part).select(*RAW_COLUMNS).coalesce(1).write.mode("append").option("header", True).option("quote", '"').option("escape", '"').csv(inbox)
    good, bad = store.Table(spark, str(tmp_path / "good"), ["id_order"], 2), store.Table(spark, str(tmp_path / "bad"), ["id_run", "source_row_number"], 2)
    take = lambda: arrivals.start(spark, inbox, str(tmp_path / "ck"), good, bad, "run", "2025-01-01T00:00:00").awaitTermination()
    write("source_row_number <= 200")
    take()
    first = good.read().count(), bad.read().count()
    assert sum(first) == 200
    take()
    assert (good.read().count(), bad.read().count()) == first
    write("source_row_number > 200")
    take()
    assert good.read().count() + bad.read().count() == 300
    assert {r.id_run for r in good.read().select("id_run").distinct().collect()} == {"run-0", "run-1"}


def test_batches_take_the_jobs_steps(spark, tmp_path):
    inbox, metrics = str(tmp_path / "inbox"), str(tmp_path / "metrics")
    rows = models.dirty(spark, "/root/testdata/sf0.001").where("source_row_number <= 100").withColumn("status", F.when(F.col("source_row_number") != 50, F.col("status")))
    rows.select(*RAW_COLUMNS).coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(inbox)
    good, bad = store.Table(spark, str(tmp_path / "good"), ["id_order"], 2), store.Table(spark, str(tmp_path / "bad"), ["id_run", "source_row_number"], 2)
    arrivals.start(spark, inbox, str(tmp_path / "ck"), good, bad, "run", "2025-01-01T00:00:00", metrics=metrics).awaitTermination()
    row = spark.read.parquet(metrics).first()
    assert (row.id_run, row.n_raw, row.balanced) == ("run-0", 100, True) and row.errors["CONTRACT_VIOLATION"] == 1
    assert good.read().count() == row.counters["inserted"] and bad.read().count() == row.n_quarantined
