"""Every registered query against its SQL twin in an independent engine, and the entry module's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tallyforge.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def twin():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def plain(v):
    return "-" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, twin, name):
    mine = catalog.queries()[name](spark, SF)
    want = twin.sql(catalog.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(mine.columns) == cols
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert [(c, {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}[t]) for c, t in sorted(mine.dtypes)] == [(c, kinds[c]) for c in cols]
    rows = lambda it, names: sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in it)
    assert rows(map(tuple, mine.collect()), mine.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
