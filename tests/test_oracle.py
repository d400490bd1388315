"""Every core query with an SQL oracle gives the rows DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from gleaner import catalog

from .conftest import canonical, rows

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
#: One extraction query a group is enough here.
NAMES = [n for n in sorted(SQL) if not n.startswith("s24_") or n.endswith(("challenge", "lines"))]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = con.execute(SQL[name])
    cols = [d[0] for d in got.description]
    at = [cols.index(c) for c in sorted(df.columns)]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(canonical(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert rows(df) == want


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(catalog.queries())
