"""Views by signed differences: what a refresh reads, and that it equals a full build."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import checks, views

SCHEMA = "id_order string, order_date string, city string, status string, payment_method string, total_amount double, items array<struct<sku string, name string, qty bigint, unit_price double, total double>>, id_run string, processed_at string"


def random_order(rng, i, stamp):
    items = [(f"S{rng.randrange(6)}", f"n{rng.randrange(3)}", rng.randrange(1, 5), 1.0, rng.randrange(1, 999) / 100) for _ in range(rng.randrange(0, 4))]
    return (f"o{i:03d}", f"2025-01-{rng.randrange(1, 7):02d}T{rng.randrange(10, 13)}:00:00", "c", "s", "m", rng.randrange(0, 9999) / 100, items, "run", stamp)


def same(v, orders):
    products = views.product_view(orders)
    assert checks.same_rows(v.daily.read().select(views.daily_view(orders).columns), views.daily_view(orders))
    assert checks.same_rows(v.products.read().select(products.columns), products)
    digest = views.order_digest(orders)
    text = lambda df: df.withColumn("lines", F.to_json("lines"))
    assert checks.same_rows(text(v.digest.read().select(digest.columns)), text(digest))
    assert checks.same_rows(v.times.read(), views.day_times(digest)) and checks.same_rows(v.postings.read(), views.product_orders(digest))


def test_random_changes_equal_a_full_build(spark, tmp_path):
    rng = random.Random(3)
    rows = {i: random_order(rng, i, "t00") for i in range(40)}
    v = views.Views(spark, str(tmp_path / "v"), 2)
    frame = lambda: spark.createDataFrame(list(rows.values()), SCHEMA)
    v.refresh(frame())
    for step in range(1, 4):
        for i in rng.sample(range(40 + 4 * step), 9):  # moved, changed and new orders; least and greatest leave
            rows[i] = random_order(rng, i, f"t{step:02d}")
        orders = frame()
        assert v.refresh(orders)["mode"] == "incremental"
        same(v, orders)


def test_a_refresh_reads_only_what_changed(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [random_order(rng, i, "t0") for i in range(60)]
    v = views.Views(spark, str(tmp_path / "v"), 4)
    orders = spark.createDataFrame(rows, SCHEMA)
    v.refresh(orders)
    late = orders.withColumns({"total_amount": F.when(F.col("id_order") == "o007", 1.0).otherwise(F.col("total_amount")), "processed_at": F.when(F.col("id_order") == "o007", "t1").otherwise("t0")})
    # neither view is computed from orders, and no index is read where no end may have left
    for name in ("daily_view", "product_view"):
        monkeypatch.setattr(views, name, lambda *a: (_ for _ in ()).throw(AssertionError("computed from orders")))
    looked = []
    read_by = v.times.read_by
    monkeypatch.setattr(v.times, "read_by", lambda wanted, empty: looked.append(wanted.count()) or read_by(wanted, empty))
    before = v.daily.manifest()
    out = v.refresh(late)
    assert (out["mode"], out["days"]) == ("incremental", 1) and looked == [0]
    after = v.daily.manifest()
    assert sum(after[b] != before[b] for b in before if b != "version") == 1
    monkeypatch.undo()
    same(v, late)


def test_the_index_of_a_group_is_read_by_its_buckets(spark, tmp_path):
    rng = random.Random(5)
    orders = spark.createDataFrame([random_order(rng, i, "t0") for i in range(60)], SCHEMA)
    v = views.Views(spark, str(tmp_path / "v"), 64)
    v.refresh(orders)
    wanted = spark.createDataFrame([("2025-01-03", 0)], "date string, part int")
    found = v.times.read_by(wanted, v.times.read())
    assert len(found.inputFiles()) < len(v.times.read().inputFiles()) / 4
    assert found.count() == views.day_times(views.order_digest(orders)).where("date = '2025-01-03' and part = 0").count()


def test_a_full_refresh_that_failed_is_run_again(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    orders = spark.createDataFrame([random_order(rng, i, "t0") for i in range(30)], SCHEMA)
    v = views.Views(spark, str(tmp_path / "v"), 2)
    v.refresh(orders)
    fewer = orders.where("id_order < 'o015'")
    monkeypatch.setattr(v.products, "replace", lambda *a: (_ for _ in ()).throw(RuntimeError("stop")))
    with pytest.raises(RuntimeError):
        v.refresh(fewer, "full")
    assert v.state()["status"] == "IN_PROGRESS"
    monkeypatch.undo()
    out = v.refresh(fewer)
    assert (out["mode"], out["recovered"]) == ("full", True) and v.state()["status"] == "IDLE"
    same(v, fewer)
    assert v.refresh(fewer)["mode"] == "NO_OP"


def test_one_view_twice_and_then_both(spark, tmp_path):
    rng = random.Random(7)
    rows = {i: random_order(rng, i, "t0") for i in range(20)}
    frame = lambda: spark.createDataFrame(list(rows.values()), SCHEMA)
    v = views.Views(spark, str(tmp_path / "v"), 2)
    v.refresh(frame())
    for step in (1, 2):
        rows[3], rows[20 + step] = random_order(rng, 3, f"t{step}"), random_order(rng, 20 + step, f"t{step}")
        assert v.refresh_one(frame(), "products")["mode"] == "incremental"
        assert v.state()["status"] == "PENDING_JOINT" and v.state()["watermark"] == "t0"
    assert checks.same_rows(v.products.read().select(views.product_view(frame()).columns), views.product_view(frame()))
    assert v.refresh(frame())["recovered"]
    same(v, frame())
