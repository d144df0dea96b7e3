"""Every query with SQL against DuckDB, on the smallest tables; the others by their rows."""

import glob
import os

import duckdb
import pytest

from lumispec import catalog

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_oracle(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted(repr([plain(v) for v in r]) for r in got.select(*[f"`{c}`" for c in order]).toLocalIterator())
    b = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in want.fetchall())
    assert len(a) == len(b) and a == b


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE])
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
