"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from dossierlake import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x) if not isinstance(x, (bool, int)) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name in plans.ORACLE_SQL:
        want = duck.sql(plans.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
