"""Every registered query against its SQL on the small tables."""

import math

import duckdb
import pytest

from seekwell import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(own.QUERIES))
def test_query(spark, duck, sf, name):
    df = own.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=str)
    assert len(set(df.columns)) == len(df.columns)
    if name not in own.SQL:
        assert got
        return
    found = duck.sql(own.SQL[name])
    assert sorted(found.columns) == cols
    at = [list(found.columns).index(c) for c in cols]
    assert got == sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=str)
