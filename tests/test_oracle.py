"""Every query with a SQL text gives the rows that DuckDB gives, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from lithic.plans import registry
from lithic.plans.base import TABLES

DIR = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (decimal.Decimal, float)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    got = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = duck.sql(registry.ORACLE_SQL[name])
    at = {c: k for k, c in enumerate(rel.columns)}
    want = sorted(repr([norm(r[at[c]]) for c in sorted(at)]) for r in rel.fetchall())
    assert sorted(at) == sorted(df.columns)
    assert got == want
