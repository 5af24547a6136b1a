"""Every registered query with oracle SQL agrees with DuckDB on the same
parquet tables (row count, column names, order-insensitive values)."""

from __future__ import annotations

import duckdb
import pytest

from tools.oracle_check import TABLES, digest, type_mismatches

import __spark_entry__ as entry

from .conftest import SF_SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def test_every_query_is_registered_with_a_name():
    assert len(QUERIES) >= 80
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert not type_mismatches(df, con.sql(SQL[name]))
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_oracle_runs(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert len(rows) >= 1


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"inception_score", "fid", "sfid", "precision", "recall"}
