"""Every registered query with SQL must give DuckDB's rows."""

import math

import duckdb
import pytest

from terraloom.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 4) + 0.0 if isinstance(x, float) else x if isinstance(x, (int, bool)) else x if isinstance(x, str) else str(x)[:19].removesuffix(" 00:00:00")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    got = registry.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == cols
    rows = lambda data, names: sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in data), key=str)
    a, b = rows([tuple(r) for r in got.collect()], got.columns), rows(want.fetchall(), want.columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) <= 2e-4 * max(1, abs(q)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, D).limit(3).collect() is not None
