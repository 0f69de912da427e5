"""What queries read, move and write, for tables larger than those of the other tests."""

import os

from conftest import DATA
from pyspark.sql import functions as F
from tallyforge.operators import store, views
from tallyforge.plans import models, stored

SF = f"{DATA}/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_numbers_of_dirty_rows_move_keys_only(spark):
    rows = models.dirty(spark, SF)
    assert "Union" not in _plan(rows)  # rows that come again are no second scan
    assert "Window" not in _plan(models.dirty_in_order(spark, SF))
    got = [r[0] for r in models.dirty_in_order(spark, SF).select("order_id").collect()]
    assert got == [r[0] for r in rows.orderBy("source_row_number").select("order_id").collect()]


def test_order_files_of_queries_are_compressed(spark):
    folder = stored._file(spark, SF)
    text = sum(len(",".join(str(x) for x in r).encode()) for r in models.dirty_in_order(spark, SF).collect())
    held = sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.startswith("part-"))
    assert 0 < held < text / 2


def _table(spark, tmp_path, **more):
    return store.Table(spark, f"file://{tmp_path}/t", ["k"], **more)


def _rows(spark, low, high, stamp="a"):
    return spark.range(low, high).select(F.concat(F.lit("k"), "id").alias("k"), "id", F.lit(stamp).alias("processed_at"))


def test_upserts_without_deletions_are_not_staged(spark, tmp_path, monkeypatch):
    def none(*a):
        raise AssertionError("staged")

    monkeypatch.setattr(store.Table, "_stage", none)
    table = _table(spark, tmp_path, buckets=3)
    assert table.upsert(_rows(spark, 0, 60).union(_rows(spark, 0, 5)), order="id") == {"inserted": 60, "updated": 5, "unchanged": 0, "keys": 60}
    assert table.upsert(_rows(spark, 50, 70, "b"), order="id") == {"inserted": 10, "updated": 10, "unchanged": 10, "keys": 20}
    assert table.read().count() == 70 and table.read().where("processed_at = 'b'").count() == 20


def test_an_upsert_of_rows_as_they_are_writes_nothing(spark, tmp_path):
    table = _table(spark, tmp_path, buckets=3)
    table.upsert(_rows(spark, 0, 60), order="id")
    before = table.manifest()
    assert table.upsert(_rows(spark, 0, 60), order="id") == {"inserted": 0, "updated": 60, "unchanged": 60, "keys": 60}
    assert table.manifest() == before and table.written().count() == 60
    # another stamp is a change that is to be stored, though the content is the same
    assert table.upsert(_rows(spark, 0, 60, "b"), order="id")["unchanged"] == 60
    assert table.manifest() != before and table.read().where("processed_at = 'b'").count() == 60


def test_tables_dealt_by_some_keys_are_moved_once(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}/p", ["k", "id"], 3, by=["k"])
    rows = lambda low, high, name: spark.range(low, high).select((F.col("id") % 4).cast("string").alias("k"), "id", F.lit(name).alias("name"))
    table.replace(rows(0, 60, "a"), about=60)
    new = rows(50, 55, "a").union(rows(55, 70, "b"))
    staged, _ = table._stage(new, 2, None, rows(0, 10, ""))
    now = table._newest()
    plan = table.merged_by(table._stored(now.schema, now.held), staged, 3)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = table.upsert(new, delete=rows(0, 10, ""))
    assert got == {"inserted": 10, "updated": 10, "unchanged": 5, "keys": 20}
    assert sorted((r["id"], r["name"]) for r in table.read().collect()) == [(i, "a" if i < 55 else "b") for i in range(10, 70)]


def test_products_of_digests_are_those_of_orders(spark):
    orders = models.orders_with_items(spark, SF)
    want, got = views._stored_products(orders), views.products_of(views.order_digest(orders))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_stored_rows_dealt_by_some_keys_are_merged_and_found_as_they_lie(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}/p", ["k", "id"], 3, by=["k"])
    rows = lambda low, high: spark.range(low, high).select((F.col("id") % 40).cast("string").alias("k"), "id")
    table.replace(rows(0, 600), about=600)
    staged, _ = table._stage(rows(500, 700), 2, None, rows(0, 10))
    now = table._newest()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with table.bucketed(now.schema, now.cut, now.held) as stored, table._joined_as_dealt():
        text = plan(table.merged(stored, staged.repartition(now.cut, "k"))[0])
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text and "Bucketed: true" in text  # of what comes in
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    wanted = rows(0, 13).select("k")
    with table.found_by(wanted, wanted) as found:
        text = plan(found)
        # keys that are broadcast leave the stored side where it is, too
        assert text.count("Exchange") - text.count("BroadcastExchange") <= 1
        assert sorted(r["id"] for r in found.collect()) == [i for i in range(600) if i % 40 < 13]
    with table.found_by(wanted.limit(0), rows(0, 1)) as found:
        assert found.count() == 0


def test_digests_of_content_make_no_text_and_tell_nulls_apart(spark):
    kind = "a string, b string, l array<struct<x: string, y: string>>, s struct<p: string, q: string>, n array<string>, m map<string, int>, d array<array<int>>"
    one = lambda a, b, x, y, p, q, n, m=None, d=None: (a, b, [(x, y)], (p, q), n, m, d)
    rows = [
        one("1", None, "x", "y", "p", "q", []), one(None, "1", "x", "y", "p", "q", []), one("1", None, "x", None, "p", "q", []), one("1", None, None, "x", "p", "q", []), one("1", None, "x", "y", "p", None, []),
        one("1", None, "x", "y", None, "p", []), one("1", None, "x", "y", "p", "q", None), one("1", None, "x", "y", "p", "q", [None]), one("1", None, "x", "y", "p", "q", ["a", None]), one("1", None, "x", "y", "p", "q", [None, "a"]),
        ("1", None, None, ("p", "q"), [], None, None), ("1", None, [("x", "y")], None, [], None, None), ("1", None, [("x", "y"), None], ("p", "q"), [], None, None), ("1", None, [None, ("x", "y")], ("p", "q"), [], None, None),
        one("1", None, "x", "y", "p", "q", [], {"a": 1}), one("1", None, "x", "y", "p", "q", [], None, [[1], [2]]), one("1", None, "x", "y", "p", "q", [], None, [[1, 2], []]),
    ]
    df = spark.createDataFrame(rows, kind)
    assert df.select(store.content_hash(df)).distinct().count() == len(rows)
    flat = df.select("a", "b", "s")
    assert "to_json" not in flat.select(store.content_hash(flat))._jdf.queryExecution().analyzed().toString()


def test_rows_of_order_files_are_dealt_once_and_item_lists_stay(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = models.dirty_in_order(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("rangepartitioning") == 1
    assert text.index("ObjectHashAggregate") < text.index("rangepartitioning")  # lists are made where their rows were dealt to
    rows = lambda df: [tuple(r) for r in df.collect()]
    want = rows(models.dirty(spark, SF).orderBy("source_row_number").drop("id_run", "source_file"))
    assert rows(models.dirty_in_order(spark, SF, numbered=True)) == want
    assert rows(models.dirty_in_order(spark, SF)) == [r[:-1] for r in want]
