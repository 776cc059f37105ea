"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from platgrid import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    r = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == names
    want = sorted((tuple(dict(zip(columns, x))[c] for c in names) for x in r.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
