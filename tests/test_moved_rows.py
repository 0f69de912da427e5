"""What the batch job moves and writes of classified rows, and how cleaning runs."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import checks, classify, job, store, views
from tallyforge.plans import models, stored
from tallyforge.plans.catalog import before_after
from tallyforge.schemas import RAW_COLUMNS

SF = "/root/testdata/sf0.001"


def test_cleaning_copies_rows_a_few_times(spark):
    plan = classify.classify(models.dirty(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    steps = plan[: plan.index("Join")]
    assert steps.count("Project [") <= 9  # a step copies the row


def test_slim_rows_are_whole_again(spark):
    rows = checks.quarantine_broken(classify.classify(models.dirty(spark, SF), "t"))
    odd = spark.createDataFrame([tuple({"order_id": "A", "order_date": "2024-01-01T00:00:00", "customer_id": "C", "items_json": i, "currency": "USD", "city": "صنعا", "total_amount": "1", "status": s}.get(c, "") for c in RAW_COLUMNS) + ("r", "f", n) for n, (i, s) in enumerate([(' [{"sku":"x","name":"","qty":1,"unit_price":1,"total":1}]', "new"), ('[{"sku":"x","qty":true}]', " new"), ("[]", "")], 1)], ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", id_run string, source_file string, source_row_number long")
    rows = rows.union(checks.quarantine_broken(classify.classify(odd, "t")))
    slim = classify.slim(rows)
    assert slim.columns == rows.columns
    as_text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect())
    before = as_text(rows)
    assert as_text(classify.whole(slim)) == before
    good = slim.where("classification != 'quarantined'")
    assert good.where("items is null and raw_record.city is null").count() > good.count() / 2


def test_rows_are_moved_slim_and_stored_whole(spark, tmp_path, monkeypatch):
    moved = []
    deal = store.Table._deal
    monkeypatch.setattr(store.Table, "_deal", lambda self, rows, *a: moved.append(rows) or deal(self, rows, *a))
    csv, root = stored._file(spark, SF), f"file://{tmp_path}/root"
    first = job.run(spark, csv, root, "r", "t", "quarantine")
    good = job.tables(spark, root)[0].read()
    assert moved[0].where("items is null").count() > good.count() / 2
    assert good.where("items is null or raw_record.city is null").count() == 0
    want = store.last_wins(classify.validated(checks.quarantine_broken(classify.classify(job.land(spark, csv, root, "r", "t"), "t"))), ["id_order"], "source_row_number")
    assert checks.same_rows(good, want)
    again = job.run(spark, csv, root, "r", "t", "quarantine")
    assert (again.counters["inserted"], again.counters["unchanged"]) == (0, good.count()) and again.rules == first.rules
    later = job.run(spark, csv, root, "r2", "t2", "quarantine")
    assert later.counters["unchanged"] == good.count() and checks.same_rows(job.tables(spark, root)[0].read().drop("id_run", "processed_at"), good.drop("id_run", "processed_at"))


def test_pending_products_are_summed_before_they_are_moved(spark):
    orders = models.orders_with_items(spark, SF)
    skus = orders.select(F.explode("items.sku").alias("sku")).distinct().where("cast(sku as int) % 3 = 0")
    got = views.products_of(views.order_digest(orders), skus)
    assert checks.same_rows(views._stored_products(orders, skus), got)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = views.products_of(views.order_digest(models.orders_with_items(spark, SF)), skus.persist())._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join LeftSemi") < plan.index("Generate explode(lines")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_recovered_refresh_takes_products_from_digests(spark, tmp_path, monkeypatch):
    before, after = before_after(spark, SF)
    root = f"file://{tmp_path}/views"
    views.Views(spark, root).refresh(before, "full", "t")
    with monkeypatch.context() as m, pytest.raises(InterruptedError):
        m.setattr(views.Views, "_recompute_skus", lambda *a: (_ for _ in ()).throw(InterruptedError()))
        views.Views(spark, root).refresh(after, "incremental", "t")
    monkeypatch.setattr(views, "_stored_products", lambda *a: (_ for _ in ()).throw(AssertionError("lines were moved")))
    v = views.Views(spark, root)
    assert v.refresh(after, "incremental", "t")["recovered"]
    assert checks.same_rows(v.products.read().select(views.product_view(after).columns), views.product_view(after))


def test_digests_are_moved_without_what_their_lines_tell(spark, tmp_path, monkeypatch):
    moved = []
    deal = store.Table._deal
    monkeypatch.setattr(store.Table, "_deal", lambda self, rows, *a: moved.append((self.path, rows.columns)) or deal(self, rows, *a))
    orders = models.orders_with_items(spark, SF)
    v = views.Views(spark, f"file://{tmp_path}/views")
    v.refresh(orders, "full", "t")
    assert ["skus" in columns for path, columns in moved if path == v.digest.path] == [False]
    assert v.digest.read().columns == views.order_digest(orders).columns and checks.same_rows(v.digest.read(), views.order_digest(orders))


def test_sound_rows_make_no_list_of_clauses(spark):
    rows = classify.classify(models.dirty(spark, SF))
    checked = checks.contract_violations(rows)
    assert "array_sort" not in checked.select("violations")._jdf.queryExecution().analyzed().toString().split("\n")[0]
    got = checked.where("size(violations) > 0").select("violations").distinct().collect()
    assert got and all(r[0] == sorted(r[0]) for r in got)
    assert checked.where("violations is null").isEmpty()
