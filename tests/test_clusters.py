"""Orders along a space-filling curve: the places against plain bisection and bit dealing, the same rows found, few rows read."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import clusters, lookups

SCHEMA = "id_order string, order_date string, city string, district string, status string, delivery_type string, total_amount double, quality_status string, customer_id string, customer_name string, payment_status string, payment_method string"


def make(n, seed=3):
    rng = random.Random(seed)
    for i in range(n):
        hot = rng.random() < 0.35  # a third of the rows share a customer and a city
        city = "c00" if hot else rng.choice([None, *[f"c{k:02d}" for k in range(30)]])
        customer = "k0000" if hot else f"k{rng.randrange(4000):04d}"
        date = f"{rng.randrange(2018, 2026)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T08:00:00"
        yield f"o{i:06d}", date, city, "d", rng.choice(["new", "paid", "sent", "done"]), "t", rng.randrange(10**6) / 100, "valid", customer, "n", "p", "m"


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clusters") / "orders")
    spark.createDataFrame(list(make(60_000)), SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def copy(orders, tmp_path_factory):
    return clusters.write(orders, str(tmp_path_factory.mktemp("clusters") / "copy"), per_file=30_000, per_page=50)


def scanned(df):
    """Rows that the scan hands on; the other pages are passed over by their index."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], None
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            n = (n or 0) + node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n


def test_places_are_the_interleaved_numbers_of_ranges(spark, orders):
    bits = 4
    bounds = clusters.range_bounds(orders, bits=bits)
    got = clusters.placed(orders.limit(500), bounds, bits).collect()
    for row in got:
        numbers = [bisect.bisect_right(bounds[c], row[c]) if row[c] is not None else 0 for c in clusters.COLUMNS]
        want = 0
        for bit in reversed(range(bits)):
            for number in numbers:
                want = want * 2 + (number >> bit & 1)
        assert row[clusters.PLACE] == want
    assert len({r[clusters.PLACE] for r in got}) > 100


def test_lookups_find_the_same_rows_and_read_few(orders, copy):
    """1,200 pages are 10 bits: two are the status's, the others about 2.7 for each column, so 1 / 6.5 of the rows for one."""
    n = orders.count()
    assert copy.count() == n and copy.exceptAll(orders).count() == 0
    calls = [
        lambda o: lookups.orders_by_city_and_status(o, "c07", "paid", 100),
        lambda o: lookups.customer_order_history(o, "k0777", 100),
        lambda o: lookups.high_value_orders(o, "2021-05-01", "2021-05-31T23:59:59", 9000, 100),
    ]
    for call, part in zip(calls, (10, 5, 5), strict=True):
        want = call(orders).collect()
        assert want and call(copy).collect() == want
        assert scanned(call(orders)) > n / 2  # dates and cities lie anywhere
        assert scanned(call(copy)) < n / part
    # what a third of the rows share, and defaults
    for call in (lambda o: lookups.customer_order_history(o, "k0000", 50), lambda o: lookups.orders_by_city_and_status(o)):
        assert call(copy).collect() == call(orders).collect()


def test_a_value_of_a_third_of_the_rows_fills_no_file_alone(orders, copy):
    sizes = [r["n"] for r in copy.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 2 and max(sizes) < 40_000


@pytest.mark.parametrize("case", ["empty", "nulls", "equal"])
def test_odd_tables(spark, tmp_path, case):
    rows = [(f"o{i}", *((None,) * 11 if case == "nulls" else ("2025-01-01T00:00:00", "a", "d", "new", "t", 1.0, "v", "k", "n", "p", "m"))) for i in range(0 if case == "empty" else 300)]
    orders = spark.createDataFrame(rows, SCHEMA)
    copy = clusters.write(orders, str(tmp_path / "copy"), per_file=100, per_page=20)
    assert sorted(copy.collect(), key=str) == sorted(orders.collect(), key=str)
    assert lookups.customer_order_history(copy, "k", 500).count() == (300 if case == "equal" else 0)


def test_too_many_bits_are_an_error(orders):
    with pytest.raises(ValueError, match="63 bits"):
        clusters.placed(orders, {c: [] for c in clusters.COLUMNS}, 16)
