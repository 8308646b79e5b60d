"""Every catalog query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from lakecat.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    if name not in catalogue.ORACLE:
        assert got.num_rows > 0
        return
    con.execute(catalogue.ORACLE[name])
    expected = con.fetchall()
    names = [d[0] for d in con.description]
    assert sorted(got.column_names) == sorted(names)
    rows = sorted(repr(r) for r in zip(*(got.column(n).to_pylist() for n in names), strict=True))
    assert rows == sorted(repr(tuple(r)) for r in expected)
    assert rows, name
