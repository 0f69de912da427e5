"""Upserts as they lie in storage, and the batch job's account of every row."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import checks, job, lookups, store
from tallyforge.schemas import RAW_RECORD


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PER_BUCKET", 30)
    return store.Table(spark, str(tmp_path / "t"), ["k"])


def numbers(spark, first, last, v="id"):
    return spark.range(first, last).selectExpr("concat('k', id) as k", f"{v} as v", "named_struct('a', id) as s")


def test_stored_rows_are_joined_as_they_lie(spark, table):
    table.upsert(numbers(spark, 0, 100))
    now = table._newest()
    staged, came = table._stage(numbers(spark, 50, 150), 2, None, None)
    assert came == 100
    with table.bucketed(staged.drop(store.GONE).schema, now.cut, now.held) as stored:
        merged, _ = table.merged(stored, staged.repartition(now.cut, *table.keys))
        text = plan(merged)
        assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text  # of what comes in
        assert "Bucketed: true" in text and "SortMergeJoin" in text
        assert merged.count() == 150


def test_buckets_split_as_the_rows_grow(spark, table):
    table.upsert(numbers(spark, 0, 100))
    assert table._newest().cut == 4
    assert table.upsert(numbers(spark, 0, 1000, "id + 1")) == {"inserted": 900, "updated": 100, "unchanged": 0, "keys": 1000}
    now = table._newest()
    assert now.cut == 32 and now.rows() == 1000 and max(n for _, n in now.held.values()) < 80
    assert checks.same_rows(table.read(), numbers(spark, 0, 1000, "id + 1"))
    # rows lie where the new number of buckets puts them
    for b in (0, 7, 31):
        keys = spark.read.parquet(table._folder(now.version, b)).select(F.pmod(F.hash("k"), F.lit(32)).alias("b")).distinct().collect()
        assert [r.b for r in keys] == [b]
    # a few buckets of many are moved rather than scanned as buckets, with the same result
    assert table.upsert(numbers(spark, 5, 6, "-1")) == {"inserted": 0, "updated": 1, "unchanged": 0, "keys": 1}
    assert table.upsert(numbers(spark, 5, 6, "-1"))["unchanged"] == 1
    assert table.read().count() == 1000 and table.read().where("v = -1").count() == 1 and table._newest().cut == 32


def test_untouched_buckets_are_not_read(spark, table):
    table.upsert(numbers(spark, 0, 1000))
    bucket = lambda k: numbers(spark, k, k + 1).select(table._bucket(table._newest().cut)).first()[0]
    mine = bucket(7)
    for b, (v, _) in table._newest().held.items():
        if b != mine:
            for f in glob.glob(f"{table._folder(v, b)}/*.parquet"):
                shutil.copy(f, f + ".kept")
                os.truncate(f, 10)
    assert table.upsert(numbers(spark, 7, 8)) == {"inserted": 0, "updated": 1, "unchanged": 1, "keys": 1}
    assert table.written().where("k = 'k7'").count() == 1
    assert table.read_by(numbers(spark, 7, 8).select("k"), numbers(spark, 0, 1)).collect()[0].v == 7


def test_counters_and_stamps(spark, table):
    rows = lambda stamp, v: spark.createDataFrame([(f"k{i}", v + (i == 3), stamp, n) for i in range(9) for n in (1, 2)], "k string, v int, processed_at string, n int")
    assert table.upsert(rows("a", 1), order="n") == {"inserted": 9, "updated": 9, "unchanged": 0, "keys": 9}
    assert table.upsert(rows("b", 1), order="n") == {"inserted": 0, "updated": 18, "unchanged": 9, "keys": 9}
    assert table.read().select("processed_at").distinct().collect() == [("b",)]
    assert table.upsert(rows("c", 1).withColumn("v", F.when(F.col("k") == "k3", 9).otherwise(F.col("v"))), order="n")["unchanged"] == 8
    assert table.upsert(rows("d", 1).limit(0), delete=rows("d", 1).select("k").where("k < 'k4'")) == {"inserted": 0, "updated": 0, "unchanged": 0, "keys": 0}
    assert table.read().count() == 5
    assert table.upsert(rows("e", 1).limit(0), order="n") == {"inserted": 0, "updated": 0, "unchanged": 0, "keys": 0}


def test_what_no_manifest_names_is_removed(spark, table):
    for i in range(5):
        table.upsert(numbers(spark, 0, 100, f"{i}"))
    assert sorted(os.listdir(f"{table.path}/data")) == ["v=4", "v=5"] and sorted(os.listdir(f"{table.path}/manifest")) == ["n=4", "n=5"]
    assert not os.path.exists(f"{table.path}/staged") or not os.listdir(f"{table.path}/staged")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tf_")]


def test_a_failed_upsert_leaves_the_last_version(spark, table, monkeypatch):
    table.upsert(numbers(spark, 0, 100))
    monkeypatch.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stop")))
    with pytest.raises(RuntimeError):
        table.upsert(numbers(spark, 0, 100, "-1"))
    monkeypatch.undo()
    assert checks.same_rows(table.read(), numbers(spark, 0, 100))
    table.upsert(numbers(spark, 0, 10, "-1"))
    assert table.read().where("v = -1").count() == 10


GOOD = ["A-1", "2025-03-02T08:30:00", "x", "C-1", "n", "771234567", "a@b.com", "c", "d", "home", "5", "cash", "paid", "15", "YER", "15", '[{"sku":"S","qty":1,"unit_price":10,"total":10}]']


@pytest.fixture
def write(spark, tmp_path):
    def put(name, rows):
        path = str(tmp_path / name)
        spark.createDataFrame([tuple(r) for r in rows], RAW_RECORD).coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
        return path

    return put


def test_no_row_is_lost_to_the_contract(spark, write, tmp_path):
    csv, root = write("a.csv", [GOOD, ["A-2", *GOOD[1:]], ["A-3", GOOD[1], "", *GOOD[3:]], ["", *GOOD[1:]]]), str(tmp_path / "root")
    first = job.run(spark, csv, root, "run-1", "2025-02-01T00:00:00", "quarantine")
    assert (first.n_raw, first.n_valid, first.n_quarantined, first.balanced, first.status) == (4, 2, 2, True, "SUCCESS")
    assert first.errors == {"MISSING_ORDER_ID": 1, "CONTRACT_VIOLATION": 1}
    assert first.counters == {"inserted": 2, "updated": 0, "unchanged": 0} and first.quarantine_counters == {"inserted": 2, "updated": 0, "unchanged": 0}
    good, bad = job.tables(spark, root)
    assert good.read().count() == 2
    broken = bad.read().where("id_order = 'A-3'").first()
    assert (broken.classification, broken.error_codes, broken.quarantine_reason) == ("quarantined", ["CONTRACT_VIOLATION"], "Record breaks the contract of stored orders: empty_status")
    assert broken.raw_record.order_id == "A-3"
    again = job.run(spark, csv, root, "run-1", "2025-02-02T00:00:00", "quarantine")
    assert again.counters == {"inserted": 0, "updated": 2, "unchanged": 2} and again.quarantine_counters == {"inserted": 0, "updated": 2, "unchanged": 2}
    assert again.attempt != first.attempt and again.processed_at == "2025-02-02T00:00:00" and (again.source_file, again.engine) == ("a.csv", "spark") and again.source_bytes > 100
    assert spark.read.parquet(f"{root}/metrics").count() == 2


def test_a_run_stands_for_one_file(spark, write, tmp_path):
    root = str(tmp_path / "root")
    job.run(spark, write("a.csv", [GOOD]), root, "run-1", "2025-02-01T00:00:00")
    with pytest.raises(ValueError, match="run-1 stands for a.csv"):
        job.run(spark, write("b.csv", [GOOD, ["A-2", *GOOD[1:]]]), root, "run-1", "2025-02-01T00:00:00")
    assert job.tables(spark, root)[0].read().count() == 1


def test_rows_missing_from_a_store_are_an_error(spark):
    good = spark.createDataFrame([("r", 1), ("other", 2)], "id_run string, n int")
    checks.require_stored("r", 3, 1, 0, good, None)
    with pytest.raises(ValueError, match="2 rows went into orders, but 1 are stored"):
        checks.require_stored("r", 3, 2, 0, good, None)


def test_row_numbers_with_gaps_and_repeats(spark):
    check = lambda *parts: tuple(checks.lineage_check(spark.createDataFrame([(n,) for p in parts for n in p], "source_row_number long").repartition(1)).first())
    assert check(range(1, 9)) == (1, 8, 8, 0, 0)
    assert check([1, 2, 2, 5]) == (1, 5, 4, 2, 1)
    many = spark.range(1, 1001, 1, 4).selectExpr("id as source_row_number")
    assert tuple(checks.lineage_check(many).first()) == (1, 1000, 1000, 0, 0)
    assert "count(distinct" not in plan(checks._intervals(many))
    assert tuple(checks.lineage_check(many.union(spark.range(400, 410).selectExpr("id as source_row_number"))).first()) == (1, 1000, 1010, 0, 10)
    assert tuple(checks.lineage_check(many.where("source_row_number not between 300 and 309")).first()) == (1, 1000, 990, 10, 0)
    assert tuple(checks.lineage_check(many.limit(0)).first())[2] == 0


def test_defaults_agree_with_what_is_given(spark):
    rows = [("1", "2025-01-01T00:00:00", "X", "d", "new", "t", 5.0, "valid", "cash", "paid", 5.0, []), ("2", "2025-01-02T00:00:00", "Y", "d", "old", "t", 7.0, "valid", "card", "open", 7.0, [])]
    orders = spark.createDataFrame(rows, "id_order string, order_date string, city string, district string, status string, delivery_type string, total_amount double, quality_status string, payment_method string, payment_status string, payment_amount double, corrections array<string>").withColumn("customer_id", F.lit("c"))
    assert [r.id_order for r in lookups.orders_by_city_and_status(orders, city="Y").collect()] == ["2"]
    assert [r.id_order for r in lookups.orders_by_city_and_status(orders, status="old").collect()] == ["2"]
    assert [r.id_order for r in lookups.orders_by_city_and_status(orders).collect()] == ["1"]
    assert [r.id_order for r in lookups.payment_settlement_audit(orders, method="card").collect()] == ["2"]
    for call in (lambda: lookups.orders_by_city_and_status(orders, city="Z"), lambda: lookups.payment_settlement_audit(orders, status="none"), lambda: lookups.customer_order_history(orders.limit(0))):
        with pytest.raises(ValueError, match="give all parameters"):
            call()
    assert lookups.orders_by_city_and_status(orders, "Y", "new").count() == 0


def test_a_job_leaves_no_scratch(spark, write, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.exists(shared) else set()
    root = str(tmp_path / "root")
    job.run(spark, write("a.csv", [GOOD]), root, "run-1", "2025-02-01T00:00:00")
    assert job.refresh(spark, root, "set", "2025-02-01T00:00:00")["mode"] == "full"
    assert set(os.listdir(shared)) == before
