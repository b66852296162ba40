"""Every query of the core runs on the smallest tables and, where it has SQL, gives what DuckDB gives."""

import decimal
import os

import pytest

from ledgerfold.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 9)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert rows
    if name in catalog.SQL:
        found = duck.execute(catalog.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
