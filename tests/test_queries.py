"""Every query with SQL gives the SQL's rows on the smallest data, and every query without gives rows."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog
from tidemark.plans.fixtures import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in got] == [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in want]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
