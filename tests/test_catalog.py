"""Every query with SQL against DuckDB on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from stowlens.plans import catalog, file_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float | Decimal):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 9)
    return bytes(v) if isinstance(v, bytes | bytearray) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    want = duck.sql(catalog.ORACLES[name])
    at = [want.columns.index(k) for k in columns]
    assert columns == sorted(want.columns)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
