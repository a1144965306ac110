"""Every raster query equals its SQL on the small tables, and gives rows."""

import glob
import os

import duckdb
import pytest

from massif import catalog

DIR = "/root/testdata/sf0.001"
ROWS_ONLY = [n for n in catalog.queries() if n not in catalog.oracle_sql()]


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{v:.5g}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) else str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([cell(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, DIR)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
