"""Every registered query against its SQL, and its plan."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


OWN = {name: fn for module in entry.MODULES for name, fn in module.QUERIES.items()}


def test_names():
    assert set(OWN) == {name for module in entry.MODULES for name in module.SQL}
    assert set(OWN) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    cur = con.execute(entry.oracle_sql()[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
    assert got[1]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("NestedLoop", "Cartesian", "PythonUDF", "MapInPandas", "FlatMapGroups"):
        assert slow not in plan + physical
