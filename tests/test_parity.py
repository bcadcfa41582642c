"""Every registered query against its SQL on the smallest sample tables."""

import math

import duckdb
import pytest

from basketry.plans import registry
from basketry.plans.sql import TABLES

SF = "/root/testdata/sf0.001"
CHECKS = registry.oracle_sql()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(spark, other, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = other.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in at) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(CHECKS)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
