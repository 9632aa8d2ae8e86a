"""The driver contract, and every query with SQL against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50 and all(callable(q) for q in queries.values())


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_parity(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    found = entry.queries()[name](spark, DATA)
    wanted = db.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    key = lambda r: tuple(map(str, r))
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=key)
    at = [wanted.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=key)
    assert ours == theirs
