"""Every query runs, and those with SQL give the same rows as DuckDB."""

import duckdb
import pytest

from voxloom.plans import inputs, registry

registry.fill()
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in inputs.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    try:
        return repr(round(float(x), 6))
    except (TypeError, ValueError):
        return str(x)


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_same_as_sql(spark, con, key):
    df = registry.QUERIES[key](spark, D)
    want = con.execute(registry.ORACLES[key])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("key", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, key):
    assert len(registry.QUERIES[key](spark, D).columns) > 0
    registry.QUERIES[key](spark, D).collect()
