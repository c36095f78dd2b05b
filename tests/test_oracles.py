"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import SQL
from latticework.plans.catalogue import QUERIES
from latticework.plans.kernels import KERNELS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(plain(v)) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rows = duck.sql(SQL[name])
    assert sorted(rows.columns) == columns
    at = [rows.columns.index(c) for c in columns]
    assert got == sorted(tuple(repr(plain(r[k])) for k in at) for r in rows.fetchall())


def test_every_query_has_sql():
    assert sorted(SQL) == sorted(QUERIES)


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_kernel_query_runs(spark, sf, name):
    """What SQL can't express runs on whole tables, twice alike; plain versions are in the tests of kernels."""
    first, again = (sorted(map(repr, KERNELS[name](spark, sf).collect())) for _ in range(2))
    assert first and first == again


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
