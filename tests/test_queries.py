"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def shown(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(map(shown, r)) for r in df.collect()]
    if name not in ORACLES:
        return
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = [tuple(shown(r[i]) for i in order) for r in found.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry_without_the_training_operators():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
