"""Sources, upserts, views and reports: metamorphic checks."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import checks, classify, job, reports, store, views
from tallyforge.plans import models
from tallyforge.schemas import RAW_COLUMNS, RAW_RECORD
from tallyforge.sources import order_files

SF = "/root/testdata/sf0.001"


def test_files_keep_order_quotes_and_lineage(spark, tmp_path):
    rows = [tuple(f"{c}-{i}" if c != "items_json" else f'[{{"a":"x, {i}"}}]' for c in RAW_COLUMNS) for i in range(5000)]
    csv = str(tmp_path / "orders")
    spark.createDataFrame(rows, RAW_RECORD).coalesce(2).write.option("header", True).option("quote", '"').option("escape", '"').csv(csv)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        raw_path = str(tmp_path / "raw")
        order_files.ingest(spark, csv, raw_path, "run-1", "2025-01-01T00:00:00+00:00")
        raw = order_files.read_raw(spark, raw_path, "run-1")
        assert tuple(checks.lineage_check(raw).first()) == (1, 5000, 5000, 0, 0)
        ordered = [r.order_id for r in raw.orderBy("source_row_number").collect()]
        assert sorted(ordered) == sorted(r[0] for r in rows)
        files = [r.order_id for f in sorted((tmp_path / "orders").glob("part-*.csv")) for r in order_files.scan(spark, str(f)).coalesce(1).collect()]
        assert ordered == files
        assert raw.where("order_id = 'order_id-7'").first().items_json == '[{"a":"x, 7"}]'
        assert order_files.read_raw(spark, raw_path, "other").count() == 0
        sample = str(tmp_path / "sample")
        order_files.sample(spark, csv, sample, 10)
        assert [r.order_id for r in order_files.numbered(order_files.scan(spark, sample)).orderBy("source_row_number").collect()] == ordered[:10]
        assert order_files.preview(spark.read.parquet(raw_path)).count() == 15
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bom_and_blank_fields(spark, tmp_path):
    f = tmp_path / "o.csv"
    f.write_text("﻿" + ",".join(RAW_COLUMNS) + "\n" + ",".join(["a", ""] + ["x"] * 15) + "\n", encoding="utf-8")
    r = order_files.scan(spark, str(f)).first()
    assert r.order_id == "a" and r.order_date is None
    assert order_files.with_lineage(order_files.numbered(order_files.scan(spark, str(f))), "r", "o.csv", "t").first().raw_record["order_date"] == ""


@pytest.fixture(scope="module")
def classified(spark):
    return classify.classify(models.dirty(spark, SF)).cache()


def test_upserts_are_idempotent(spark, classified, tmp_path):
    good = store.Table(spark, str(tmp_path / "good"), ["id_order"], 4)
    bad = store.Table(spark, str(tmp_path / "bad"), ["id_run", "source_row_number"], 4)
    valid, broken = classify.validated(classified), classify.quarantined(classified)
    store.store_run(valid, broken, good, bad)
    first = good.read().drop("bucket").cache()
    n = first.count(), bad.read().count()
    assert checks.store_check(first).first().asDict() == {"repeated_keys": 0, "negative_money": 0, "contract_failures": 0}
    last = valid.groupBy("id_order").agg(F.max("source_row_number").alias("source_row_number"))
    assert checks.same_rows(first.select("id_order", "source_row_number"), last)
    store.store_run(valid, broken, good, bad)
    assert (good.read().count(), bad.read().count()) == n and n[1] == broken.count()
    counts = store.upsert_counts(first, valid, ["id_order"], "source_row_number").first()
    assert (counts.inserted, counts.updated, counts.unchanged) == (0, valid.count(), n[0])


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ["k"], 8)
    rows = spark.range(100).selectExpr("id as k", "1 as v")
    t.upsert(rows)
    before = t.manifest()
    t.upsert(spark.createDataFrame([(5, 2)], "k long, v int"))
    after = t.manifest()
    assert sum(after[b] != before[b] for b in before if b != "version") == 1
    assert t.read().agg(F.sum("v")).first()[0] == 101
    t.upsert(rows.limit(0), delete=rows.where("k < 50").select("k"))
    assert t.read().count() == 50


def test_balance_and_metrics(classified):
    assert checks.consistency(classified).first().balanced
    m = checks.run_metrics(classified, "run-1", 2.0, {"inserted": 3}).first()
    assert m.n_raw == classified.count() and m.rules["RULE_07"] > 0 and m.errors["EMPTY_ITEMS"] > 0 and m.counters == {"inserted": 3}


def test_partitioning_changes_nothing(spark):
    raw = models.dirty(spark, SF).limit(200).cache()
    a, b = (classify.classify(raw.repartition(n)).select("source_row_number", "classification", "error_codes", F.to_json("corrections").alias("c")) for n in (1, 7))
    assert checks.same_rows(a, b)


@pytest.fixture
def orders(spark):
    rows = [
        (f"o{i}", f"2025-01-{1 + i % 5:02d}T10:00:00", "c", "s", "m", float(10 * i), [("A" if i % 2 else "B", "n", 1, 1.0, float(i))], "run-1", "2025-02-01T00:00:00") for i in range(20)
    ]
    return spark.createDataFrame(rows, "id_order string, order_date string, city string, status string, payment_method string, total_amount double, items array<struct<sku string, name string, qty bigint, unit_price double, total double>>, id_run string, processed_at string")


def live(v: views.Views, orders):
    return checks.same_rows(v.daily.read().select(views.daily_view(orders).columns), views.daily_view(orders)) and checks.same_rows(v.products.read().select(views.product_view(orders).columns), views.product_view(orders)) and checks.same_rows(v.digest.read().select("id_order", "order_date_day", "skus"), views.order_digest(orders).select("id_order", "order_date_day", "skus"))


def change(orders, when, stamp, **columns):
    hit = F.expr(when)
    out = orders
    for c, e in (columns | {"processed_at": f"'{stamp}'"}).items():
        out = out.withColumn(c, F.when(hit, F.expr(e)).otherwise(F.col(c)))
    return out


def test_view_lifecycle(spark, orders, tmp_path, monkeypatch):
    v = views.Views(spark, str(tmp_path / "v"), 2)
    assert v.status(orders)["status"] == "UNINITIALIZED"
    assert v.refresh(orders)["mode"] == "full" and live(v, orders)
    assert v.refresh(orders)["mode"] == "NO_OP"
    new = orders.limit(1).withColumns({"id_order": F.lit("new"), "order_date": F.lit("2025-03-01T00:00:00"), "processed_at": F.lit("2025-02-02T00:00:00"), "items": F.expr("array(named_struct('sku', 'NEW', 'name', 'n', 'qty', 1L, 'unit_price', 1D, 'total', 2D))")})
    grown = spark.createDataFrame(orders.unionByName(new).collect(), orders.schema)
    out = v.refresh(grown)
    assert (out["mode"], out["days"], out["skus"]) == ("incremental", 1, 1) and live(v, grown)
    dearer = change(grown, "id_order = 'o3'", "2025-02-03T00:00:00", total_amount="total_amount + 5")
    assert v.refresh(dearer)["mode"] == "incremental" and live(v, dearer)
    moved = change(dearer, "id_order = 'new'", "2025-02-04T00:00:00", order_date="'2025-03-02T00:00:00'")
    assert v.refresh(moved)["deleted"] == {"days": 1, "skus": 0} and live(v, moved)
    swapped = change(moved, "id_order = 'new'", "2025-02-05T00:00:00", items="array(named_struct('sku', 'A', 'name', 'n', 'qty', 1L, 'unit_price', 1D, 'total', 2D))")
    assert v.refresh(swapped)["deleted"] == {"days": 0, "skus": 1} and live(v, swapped)
    assert v.refresh(swapped)["mode"] == "NO_OP" and live(v, swapped)
    # a failure after the daily step leaves the watermark, and the next refresh completes it
    late = change(swapped, "id_order = 'o4'", "2025-02-06T00:00:00", order_date="'2025-04-01T00:00:00'")
    monkeypatch.setattr(v, "_recompute_skus", lambda *a: (_ for _ in ()).throw(RuntimeError("stop")))
    with pytest.raises(RuntimeError):
        v.refresh(late)
    assert v.state()["status"] == "IN_PROGRESS" and v.state()["watermark"] == "2025-02-05T00:00:00"
    monkeypatch.undo()
    out = v.refresh(late)
    assert out["recovered"] and out["mode"] == "incremental" and live(v, late)
    again = change(late, "id_order = 'o5'", "2025-02-07T00:00:00", total_amount="1D")
    assert v.refresh_one(again, "daily")["mode"] == "incremental" and v.state()["status"] == "PENDING_JOINT"
    assert v.refresh(again)["recovered"] and live(v, again)
    status = v.status(again)
    assert status["status"] == "IDLE" and status["rows"]["orders"] == 21 and status["rows"]["digest"] == 21
    assert views.read_daily(v.daily.read(), "2025-01-02", "2025-01-04").count() == 3 and views.read_products(v.products.read(), 1).count() == 1


def test_reports_reconcile_and_publish(spark, orders, tmp_path):
    per = [reports.daily_sales(orders), reports.sales_by_city(orders), reports.payment_method_analysis(orders), reports.status_distribution(orders)]
    assert checks.reports_reconcile(orders, *per)
    root = str(tmp_path / "reports")
    reports.publish(orders, root, "r1")
    assert checks.same_rows(reports.published(spark, root, "sales_by_city"), reports.sales_by_city(orders))
    with pytest.raises(Exception):
        reports.publish(orders.drop("status"), root, "r2")
    assert reports.published(spark, root, "order_status_distribution").count() == 1


def test_arguments_are_checked(orders):
    for call in (lambda: reports.daily_sales(orders, limit=0), lambda: reports.daily_sales(orders, "2025-02-01", "2025-01-01"), lambda: reports.daily_sales(orders, start="yesterday")):
        with pytest.raises(ValueError):
            call()


def test_batch_job_from_file_to_metrics(spark, tmp_path):
    good = ["ORD-1", "2025-01-15T10:00:00", "x", "C-1", "n", "771234567", "a@b.com", "c", "d", "home", "5", "cash", "paid", "15", "YER", "15", '[{"sku":"S","qty":1,"unit_price":10,"total":10}]']
    rows = [good, ["ORD-2", *good[1:]], ["ORD-2", *good[1:2], "y", *good[3:]], ["", *good[1:]]]
    write = lambda name, rows: spark.createDataFrame([tuple(r) for r in rows], RAW_RECORD).coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / name))
    write("a.csv", rows)
    root = str(tmp_path / "root")
    for _ in range(2):  # the second time changes nothing
        done = job.run(spark, str(tmp_path / "a.csv"), root, "run-1", "2025-02-01T00:00:00")
        orders, bad = job.tables(spark, root)
        assert (done.n_raw, done.n_valid, done.n_quarantined, done.errors) == (4, 3, 1, {"MISSING_ORDER_ID": 1})
        assert sorted((r.id_order, r.status) for r in orders.read().collect()) == [("ORD-1", "x"), ("ORD-2", "y")] and bad.read().count() == 1
    assert spark.read.parquet(f"{root}/metrics").count() == 2 and spark.read.parquet(f"{root}/raw").count() == 4
    counters = [r.counters for r in spark.read.parquet(f"{root}/metrics").collect()]
    assert {"inserted": 2, "updated": 1, "unchanged": 0} in counters and {"inserted": 0, "updated": 3, "unchanged": 2} in counters
    # a blank status is no error of a rule, but breaks the contract: nothing is stored
    write("b.csv", [["ORD-3", *good[1:]], ["ORD-4", good[1], "", *good[3:]]])
    with pytest.raises(ValueError, match="ORD-4.*empty_status"):
        job.run(spark, str(tmp_path / "b.csv"), root, "run-2", "2025-02-02T00:00:00")
    assert job.tables(spark, root)[0].read().count() == 2
    job.run(spark, str(tmp_path / "b.csv"), root, "run-2", "2025-02-02T00:00:00", "quarantine")
    assert job.tables(spark, root)[0].read().count() == 3
    assert job.refresh(spark, root, "first", "2025-02-03T00:00:00")["mode"] == "full"
    assert reports.published(spark, f"{root}/reports", "sales_by_city").first().order_count == 3
    with pytest.raises(ValueError, match="4 raw rows"):
        checks.require_balance(spark.range(4), spark.createDataFrame([("valid",)], "classification string"))


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PER_BUCKET", 30)
    t = store.Table(spark, str(tmp_path / "t"), ["k"])
    t.upsert(spark.range(100).selectExpr("id as k", "1 as v"))
    t.upsert(spark.range(50, 110).selectExpr("id as k", "2 as v"))
    assert len(t.manifest()) == 5 and t.read().groupBy("v").count().orderBy("v").collect() == [(1, 50), (2, 60)]
