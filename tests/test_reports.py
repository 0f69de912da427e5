"""Ranks, duplicates, the report suite and the product index: against plain computation, and what their plans move."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import checks, lookups, profile, reports, store, views
from tallyforge.schemas import RAW_COLUMNS, RAW_RECORD


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["spread", "equal", "skewed", "few", "one", "none", "wide"])
def test_quartiles_are_those_of_the_sorted_values(spark, kind):
    rng = random.Random(kind)
    values = {
        "spread": [rng.uniform(-50, 9000) for _ in range(4001)],
        "equal": [5.0] * 700 + [1.0, 9.0] * 40,
        "skewed": [math.exp(rng.gauss(0, 6)) for _ in range(3000)],
        "few": [3.0, 1.0, 2.0],
        "one": [7.5],
        "none": [],
        "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300, 1.0, 2.0, 2.0000000000000004],
    }[kind]
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "total_amount double").repartition(3)
    got = tuple(profile.quartiles(df).first())
    ordered = sorted(values)
    want = tuple(ordered[max(1, math.ceil(s * len(ordered))) - 1] if ordered else None for s in (0, 0.25, 0.5, 0.75, 1))
    assert got == want


def test_only_rows_whose_hash_is_seen_twice_are_compared(spark):
    row = lambda i, city="c": tuple(f"{c}{i}" if c != "city" else city for c in RAW_COLUMNS)
    rows = [row(i) for i in range(200)] + [row(3), row(3), row(9), row(10, "other"), row(11, None), row(11, None)]
    raw = spark.createDataFrame(rows, RAW_RECORD)
    # keys 3, 9, 10 and 11 come again; rows 3 and 9 and the two of 11 without a city
    assert tuple(profile.duplicates(raw).first()) == (4, 6, 3, 4)
    assert profile.seen_twice(raw).count() == 7
    assert tuple(profile.duplicates(raw.limit(0)).first()) == (0, 0, 0, 0)


@pytest.fixture
def orders(spark):
    rng = random.Random(1)
    rows = [(f"o{i}", f"2025-01-{1 + i % 9:02d}T10:00:00", rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice(["m", "n", "o"]), rng.randrange(9999) / 100, [(f"S{i % 4}", "n", 1, 1.0, 2.5)]) for i in range(120)]
    return spark.createDataFrame(rows, "id_order string, order_date string, city string, status string, payment_method string, total_amount double, items array<struct<sku string, name string, qty bigint, unit_price double, total double>>")


def test_the_suite_is_the_five_reports(spark, orders, tmp_path):
    orders.write.parquet(str(tmp_path / "o"))
    stored = spark.read.parquet(str(tmp_path / "o"))
    made = reports.suite(stored, 3)
    assert list(made) == list(reports.REPORTS)
    for name, df in made.items():
        want = reports.top_products(stored, 3) if name == "top_products" else reports.REPORTS[name](stored)
        assert df.columns == want.columns and df.collect() == want.collect(), name
    text = plan(reports.grouped_sums(stored))
    assert text.count("FileScan") == 1 and "items" not in text.split("ReadSchema")[1] and "Expand" in text
    assert checks.reports_reconcile(stored, *[made[n] for n in made if n != "top_products"])


def test_the_product_index_reads_few_buckets(spark, orders, tmp_path):
    stamped = orders.withColumns({"id_run": F.lit("r"), "processed_at": F.lit("t0")})
    table, v = store.Table(spark, str(tmp_path / "orders"), ["id_order"], 64), views.Views(spark, str(tmp_path / "v"), 64)
    with pytest.raises(ValueError, match="refresh"):
        lookups.orders_by_product_sku_indexed(table, v.postings, "S1")
    table.upsert(stamped)
    v.refresh(table.read())
    found = lookups.orders_by_product_sku_indexed(table, v.postings, "S1", 5)
    assert found.collect() == lookups.orders_by_product_sku(orders, "S1", 5).collect()
    assert len(found.inputFiles()) <= 6 < len(table.read().inputFiles()) / 4
    # an order that loses its SKU is no longer found, one that gains it is
    items = lambda sku: F.array(F.struct(F.lit(sku).alias("sku"), F.lit("n").alias("name"), F.lit(1).cast("long").alias("qty"), F.lit(1.0).alias("unit_price"), F.lit(1.0).alias("total")))
    changed = stamped.where("id_order in ('o1', 'o2')").withColumns({"items": F.when(F.col("id_order") == "o1", items("S9")).otherwise(items("S1")), "processed_at": F.lit("t1")})
    table.upsert(changed)
    v.refresh(table.read())
    ids = [r.id_order for r in lookups.orders_by_product_sku_indexed(table, v.postings, "S1", 200).collect()]
    assert "o2" in ids and "o1" not in ids
    assert ids == [r.id_order for r in lookups.orders_by_product_sku(table.read(), "S1", 200).collect()]
