import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyforge.llm import hard_negatives as hn
from tallyforge.llm.catalog import op12_hard_negatives

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, vector) that take part. Plain inner products in Python's whole numbers."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  what one lacks counts as zero
    last = lambda r: (r[1] is None, r[1] or 0)
    for a, label, v in rows:
        if a is None or not is_anchor(a):
            continue
        scored = [(dot(v, w), i, own) for i, own, w in rows]
        best = sorted((s for s in scored if s[2] == label and s[1] != a), key=lambda r: (-r[0], last(r)))[:positives]
        for p, i, _ in best:
            fits = sorted((s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p), key=lambda r: (-r[0], last(r)))[:negatives]
            out += [(a, i, n, j, p, s) for n, (s, j, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 200, 1 << 20])
def test_lookups_are_inner_products(most):
    rng = np.random.default_rng(most)
    for dims in (0, 1, 7, 8, 13, 64):
        a, c = rng.integers(-most, most + 1, (9, dims)), rng.integers(-most, most + 1, (21, dims))
        assert (hn.scores(hn.subset_sums(a, np.int64), hn.bit_planes(c)) == c @ a.T).all()
        if most == 200:
            assert (hn.scores(hn.subset_sums(a, np.int32), hn.bit_planes(c)) == c @ a.T).all()


def run(df, **options):
    got = hn.hard_negatives(df, F.col("id") % 10 == 0, **options)
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=str)


def test_mined_rows_are_those_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(-9, 10, (12, 13))
    # near vectors, many equal ones (ties), several labels
    rows = [(i, int(rng.integers(0, 3)), [int(x) for x in base[i % 12] + (rng.integers(-3, 4, 13) if i % 3 else 0)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<bigint>")
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert run(df) == want
    monkeypatch.setattr(hn, "BLOCK", 7)
    monkeypatch.setattr(hn, "CHUNK", 32)
    assert run(df.repartition(3), part_bytes=2000) == want
    assert run(df, positives=2, negatives=3, low=10, high=50) == plain(rows, lambda i: i % 10 == 0, 2, 3, 10, 50)


def test_odd_rows(spark):
    rows = [
        (10, 1, [1, 2, 3], "x"), (11, 1, [2, 2, 3], "x"), (12, 1, [2, 2, 3], "x"), (12, 1, [2, 2, 3], "x"), (13, 2, [1, 1, 1], "x"), (13, 2, [1, 1, 1], "x"),
        (None, 2, [1, 1, 1], "x"), (14, None, [5, 5, 5], "x"), (15, 2, None, "x"), (16, 2, [1, None, 1], "x"), (17, 2, [], "x"), (18, 2, [1, 1], "x"), (19, 2, [1, 1, 1, 400], "x"),
        (20, 3, [-5, 0, 0], "x"), (21, 3, [7, 0, 0], "x"), (30, 4, [0], "x"), (31, 4, [0], "x"),
    ]
    df = spark.createDataFrame(rows, "id long, label int, vector array<bigint>, score string")
    for c in ("anchor", "rank", "slot", "positives", "is_anchor"):
        df = df.withColumn(c, F.lit("x"))
    whole = [r[:3] for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    got, want = run(df), plain(whole, lambda i: i % 10 == 0)
    assert got == want and any(r[3] is None for r in got) and any(r[4] == r[5] == 0 for r in got)
    assert run(df.limit(0)) == [] and run(df.where("id = 11")) == []


def test_vectors_of_the_query(spark):
    rows = [(7, 9, [0.5, -0.001, 2.0]), (8, 9, [float("nan")]), (9, 9, [float("inf")]), (10, 9, [None]), (11, None, [1.0]), (12, 1, None), (14, None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in hn.whole_vectors(df).where("label is not null").collect()] == [(7, 0, [128, -1, 512])]


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = db.sql(hn.ORACLE_SQL)
    got = op12_hard_negatives(spark, sf)
    cols = list(want.columns)
    assert sorted(cols) == sorted(got.columns)
    rows = want.fetchall()
    assert len(rows) > 100 and sorted(map(tuple, got.select(*cols).collect())) == sorted(rows)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
